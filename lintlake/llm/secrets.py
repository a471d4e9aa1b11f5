"""Secrets in text, by candidates and a random forest, all in DataFrame functions.

Candidates are whatever is assigned to a name that holds password, token or the like (the whole quoted value, or all up to white space, whatever its characters, its length and the
blanks around the sign), and runs of 16 or more key characters with a digit ("=" only as padding at the end). One replacement puts marks around all of them and a
split at the marks gives the pieces. A forest over their length, character transitions, dictionary coverage, path and neighbouring words tells secrets from false positives. It is
fitted on labelled findings and then written out as column expressions, so scoring is a projection: no join, shuffle or Python.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import string_col

#: Characters kept of each side of a candidate.
SIDE = 48
THRESHOLD, MASK = 0.5, "[SECRET]"
# Fixed word lists: names that secrets are assigned to, names of harmless values, stand-ins, dictionary words, letter pairs.
KEYWORD = r"(?:token|secret|passw|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer|client[_-]?key|signing)"
HARMLESS = r"(?:sha\d*|md5|commit|checksum|digest|etag|hash|uuid|guid|revision|fingerprint|integrity|build|version|order|invoice|phone|iban|card|isbn|serial)"
STAND_IN = r"(?:example|sample|placeholder|dummy|your|changeme|xxxx|\*{4}|\.{3}|0{8}|1234567|abcdef|test|fake|redacted|todo)"
# What names and runs are made of.
_KEY = r"A-Za-z0-9+/_.\-"
_SIGN = r"[\"'\])]{0,3}+[ \t]*+(?::=|=>|[:=])[ \t]*+"
#: Matched at the beginning of a run of key characters: name (1), what stands up to the value (2; 3 and 5 the opening quote), value (4, 6, 7), or a run (8). Loops are possessive
#: or stay inside one run, so time grows with the text, and no length is bounded. The sign is looked for before the keyword, since few words have one.
CANDIDATE = (
    rf"(?<![{_KEY}])(?:(?=[{_KEY}]++{_SIGN})(?=[{_KEY}]*?(?i:{KEYWORD}))([{_KEY}]++)({_SIGN})"
    r"(?:(\")([^\"\n]{4,}+)(?=\")|(')([^'\n]{4,}+)(?=')|([^\s\"'`,;:=>][^\s\"'`,;]{3,}+))"
    rf"|((?=[A-Za-z+/_.\-]*+[0-9])[{_KEY}]{{16,}}+={{0,2}}))"
)
#: Pieces of a candidate: the text before it, the name, what stands up to the value, the value.
STEP, CHUNK = 4, 256
MARK = "\u0001|\u0002"
#: A value that is code, a reference or a template rather than text.
CODE = r"[(){}<>\[\]]|\$\w|%\(|^(?i:none|null|true|false|string|str|required|optional)$|^[a-z_]+(?:\.[a-z_]+)+$"
DICTIONARY = "about|access|account|address|after|alpha|also|archive|article|asset|back|base|because|before|beta|book|build|cache|change|class|client|code|color|config|content|count|country|data|date|default|delete|device|docs|document|down|email|error|event|example|field|file|final|first|folder|format|from|group|guide|have|header|health|home|html|http|image|index|info|input|item|items|json|label|language|large|last|lib|library|list|local|login|main|manager|media|menu|message|model|module|month|name|network|news|node|notes|number|object|option|order|output|package|page|path|people|photo|place|plugin|point|post|price|print|process|product|profile|project|public|query|read|record|release|report|request|response|result|root|sample|schema|script|search|section|select|server|service|session|set|shop|simple|site|size|small|source|start|state|static|status|store|string|style|summer|support|system|table|tag|team|template|test|text|time|title|tools|train|type|update|upload|user|users|value|version|video|view|web|week|window|winter|word|work|world|year".split("|")
PAIRS = "al an ar as at co de ed en er es ha he hi in io is it la le me nd ne ng nt of on or ou ra re ri ro se st te th ti to ur ve".split()

FEATURES = ("length", "transitions", "distinct", "digits", "uppers", "dictionary", "pairs", "hex", "slashes", "dots", "keyword", "harmless", "assigned", "quoted", "stand_in", "in_path", "test_path", "prefix", "punctuation", "code", "spaces", "kinds")


def _share(part: Column, of: Column) -> Column:
    return part / F.greatest(F.length(of), F.lit(1))


def features(value: Column, left: Column, right: Column, path: Column) -> dict[str, Column]:
    """The forest's inputs for a candidate with the text on its left and right, and the path (or source) that it was found in."""
    low, before = F.lower(value), F.lower(left)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "[^0aA]", "-")
    name = F.regexp_extract(before, r"([a-z0-9_.\-]+)[\s\"']*(?:[:=]+[>\s]*|\s)[\"']?$", 1)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "length": F.least(F.length(value), F.lit(400)).cast("double"),
        "transitions": _share(F.regexp_count(kinds, F.lit(r"(?=(.)(?!\1).)")), value),
        "distinct": _share(F.size(F.array_distinct(F.split(low, ""))), value),
        "digits": _share(F.regexp_count(value, F.lit("[0-9]")), value),
        "uppers": _share(F.regexp_count(value, F.lit("[A-Z]")), value),
        "dictionary": 1 - _share(F.length(F.regexp_replace(low, f"(?:{'|'.join(sorted(DICTIONARY, key=len, reverse=True))})", "")), value),
        "pairs": _share(F.regexp_count(low, F.lit(f"(?={'|'.join(PAIRS)})")), value),
        "hex": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & value.rlike("[A-Fa-f]")),
        "slashes": F.regexp_count(value, F.lit("/")).cast("double"),
        "dots": F.regexp_count(value, F.lit(r"\.")).cast("double"),
        "keyword": flag(name.rlike(KEYWORD)),
        "harmless": flag(name.rlike(HARMLESS)),
        "assigned": flag(left.rlike("[:=]>?\\s*[\"']?$")),
        "quoted": flag(left.rlike("[\"']$") & right.rlike("^[\"']")),
        "stand_in": flag(low.rlike(STAND_IN)),
        "in_path": flag(left.rlike(r"(?:[/\\@?&]|https?:\S*)$") | right.rlike(r"^[/\\?&@]")),
        "test_path": flag(F.lower(path).rlike(r"(?:^|[/_.\-])(?:tests?|fixtures?|examples?|mocks?)(?:$|[/_.\-])")),
        "prefix": flag(value.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-|AIza|eyJ)")),
        "punctuation": F.regexp_count(value, F.lit(r"[^A-Za-z0-9\s_.\-/]")).cast("double"),
        "code": flag(value.rlike(CODE)),
        "spaces": F.regexp_count(value, F.lit(r"\s")).cast("double"),
        "kinds": flag(value.rlike("[a-z]")) + flag(value.rlike("[A-Z]")) + flag(value.rlike("[0-9]")) + flag(value.rlike(r"[^A-Za-z0-9\s_.\-/]")),
    }


def _free(columns: list[str]) -> str:
    """A beginning that no column's name has."""
    name = "__"
    while any(c.lower().startswith(name) for c in columns):
        name += "_"
    return name


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with further columns, each computed once a row: a generator's output, which the optimiser doesn't put in place of its uses."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def candidates(docs: DataFrame, text_col: str = "text", own: str = "__") -> DataFrame:
    """docs with pieces: for each candidate the text before it, its name, what stands up to its value and its value; the rest of the text last.

    The pieces joined are the text, and a text without candidates is one piece. own: what the column's name begins with. The marks are characters that the text
    doesn't hold: where it holds the usual ones, they carry its digest.
    """
    text = string_col(docs, text_col)
    mark = F.when(text.contains(MARK), F.concat(F.lit("\u0001"), F.sha2(text, 256), F.lit("\u0002"))).otherwise(F.lit(MARK))
    around = F.concat(mark, F.lit("$1"), mark, F.lit("$2$3$5"), mark, F.lit("$4$6$7$8"), mark)
    quoted = F.regexp_replace(mark, r"\|", r"\\|")  # a split is by a pattern
    return _once(docs, **{f"{own}pieces": F.split(F.regexp_replace(text, F.lit(CANDIDATE), around), quoted, -1)})


def _part(i: Column, k: int, own: str = "__") -> Column:
    """Piece k of candidate i (from 0): 0 the text before, 1 name, 2 up to the value, 3 value, 4 the text behind it."""
    return F.element_at(f"{own}pieces", (i * STEP + k + 1).cast("int"))


def _sides(i: Column, own: str = "__") -> tuple[Column, Column]:
    """The text on the left and right of candidate i: blanks before the value count as one, and a name stays whole up to a hundred characters beyond SIDE."""
    gap = F.regexp_replace(_part(i, 2, own), r"[ \t]+", " ")
    return F.concat(F.right(_part(i, 0, own), F.lit(SIDE)), F.right(_part(i, 1, own), F.lit(SIDE + 100)), gap), F.substring(_part(i, 4, own), 1, SIDE)


def _numbers(own: str = "__") -> Column:
    """The candidates' numbers, from 0."""
    n = F.floor(F.size(f"{own}pieces") / STEP).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def default_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """value, left, right, path, label: the candidates that scanning gives in lines made by rule from row numbers; odd rows hold secrets."""
    n = F.col("id")
    m = F.floor(n / 2)  # the kind of a row is drawn from this, so that both labels get every kind
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), n.cast("string")), 256)
    mixed = F.translate(F.base64(F.unhex(digest("m"))), "+/=", "Zq7")
    pick = lambda salt, options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    hexes = F.substring(digest("h"), 1, pick("hl", (32, 40, 64, 24)))
    hexes = F.when(F.pmod(F.xxhash64(n, F.lit("hu")), F.lit(5)) == 0, F.upper(hexes)).otherwise(hexes)
    joint = pick("ws", ("-", "_", "/", ".", ""))
    words = F.concat(pick("w0", DICTIONARY), joint, pick("w1", DICTIONARY), joint, pick("w2", DICTIONARY), joint, pick("w3", DICTIONARY))
    key = pick("k", ("token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "TOKEN", "Private-Key", "bearer", "credential", "DB_PASSWD"))
    safe = pick("s", ("commit", "sha256", "checksum", "md5", "etag", "uuid", "build", "version", "digest", "order", "phone", "card", "revision", "serial", "isbn"))
    assign = pick("a", (' = "', "='", ": ", "=", ' => "', ' = "', ' := "'))
    close = pick("a", ('"', "'", " ", "", '"', '"', '"'))
    secret = F.when(m % 5 == 0, F.concat(pick("p", ("AKIA", "ghp_", "glpat-", "xoxb-", "sk_live_")), F.substring(mixed, 1, 36))).when(m % 5 == 1, F.substring(mixed, 1, pick("ml", (20, 24, 32, 40)))).otherwise(hexes)
    harmless = (
        F.when(m % 8 == 0, hexes)
        .when(m % 8 == 1, F.concat(words, pick("wn", ("1", "2024", "42", "7", "003"))))
        .when(m % 8 == 2, F.regexp_replace(digest("u"), "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5"))
        .when(m % 8 == 3, F.lpad(F.pmod(F.xxhash64(n, F.lit("d")), F.lit(10**16)).cast("string"), 16, "4"))
        .when(m % 8 == 4, F.concat(words, F.lit("/"), F.substring(hexes, 1, 12), F.lit(".html")))
        .when(m % 8 == 5, F.concat(pick("ph", ("your_token_here_", "example-key-", "xxxxxxxxxxxx", "changeme_", "placeholder-", "test_secret_")), F.lit("0123456789")))
        .when(m % 8 == 6, F.repeat(pick("r", ("-=", "0", "1", "_9", "=2")), 24))
        .otherwise(F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("T10.20.30.123Z")))
    )
    text = pick("t", ("and the ", "see also ", "of this ", "ndon er the ", "de la ", "\n", "was not "))
    good = n % 2 == 1
    known = (m % 10 == 5) & good  # a known prefix without a telling name
    kind = m % 8
    left = F.when(good & ~known, F.concat(text, key, assign)).when(good, text).when(kind == 5, F.concat(text, key, assign)).when(kind == 4, F.concat(text, F.lit("https://site/"))).when(kind.isin(1, 6), text)
    left = left.otherwise(F.concat(text, F.when(F.pmod(F.xxhash64(n, F.lit("b")), F.lit(3)) == 0, F.lit("")).otherwise(F.concat(safe, pick("sa", (" ", ": ", "=", ' = "'))))))
    right = F.when(good & ~known | (kind == 5), close).otherwise(F.lit(" "))
    made = spark.range(rows).select(n, F.when(good, secret).otherwise(harmless).alias("value"), left.alias("left"), right.alias("right"))
    # a second set: passwords of any length and without digits, and what else is assigned to such names
    letters = F.regexp_replace(F.base64(F.unhex(digest("l"))), "[^A-Za-z]", "")
    mark = lambda salt: pick(salt, ("!", "#", "@", "$", "%", "&", "*", "?", "!9", "_7"))
    capital = F.concat(F.initcap(pick("c0", DICTIONARY)), F.initcap(pick("c1", DICTIONARY)))
    short = (
        F.when(m % 6 == 0, F.concat(pick("w0", DICTIONARY), F.pmod(F.xxhash64(n), F.lit(999)).cast("string"), mark("x0")))
        .when(m % 6 == 1, F.substring(letters, 1, pick("ll", (16, 20, 24, 30))))
        .when(m % 6 == 2, F.concat(F.substring(mixed, 1, pick("sl", (4, 6, 8))), mark("x1"), F.substring(mixed, 20, pick("sm", (1, 3, 5)))))
        .when(m % 6 == 3, F.concat(capital, mark("x2"), F.pmod(F.xxhash64(n), F.lit(99)).cast("string")))
        .when(m % 6 == 4, F.base64(F.unhex(F.substring(digest("b"), 1, pick("bl", (32, 36, 40, 48))))))
        .otherwise(F.concat(F.substring(mixed, 1, 4), F.lit("r3"), pick("w1", DICTIONARY), mark("x3"), F.substring(mixed, 9, 2)))
    )
    none = (
        F.when(m % 6 == 0, pick("n0", DICTIONARY))
        .when(m % 6 == 1, F.concat(pick("f", ("get_", "read_", "os.environ", "request.", "self.", "settings.", "load")), pick("w0", DICTIONARY), pick("fe", ("()", "(name)", "['KEY']", "", "[0]"))))
        .when(m % 6 == 2, pick("tp", ("None", "null", "true", "False", "string", "required", "optional", "${TOKEN}", "{{ secret }}", "<password>", "%(pwd)s", "****", "********", "xxxxxxxx", "changeme", "your-token-here", "example", "redacted", "password", "secret")))
        .when(m % 12 == 10, F.concat(pick("tl", ("${", "{{ ", "<", "%(", "$(")), F.upper(pick("w0", DICTIONARY)), F.lit("_"), F.upper(pick("w1", DICTIONARY)), pick("tl", ("}", " }}", ">", ")s", ")"))))
        .when(m % 6 == 3, F.concat(pick("w0", DICTIONARY), F.lit(" "), pick("w1", DICTIONARY), F.lit(" "), pick("w2", DICTIONARY)))
        .when(m % 6 == 4, F.concat(pick("w0", DICTIONARY), pick("j", ("-", "_", "/", ".")), pick("w1", DICTIONARY)))
        .otherwise(F.concat(pick("st", ("your_", "example-", "test_", "changeme_", "dummy-")), pick("w1", DICTIONARY), F.lit("123")))
    )
    more = spark.range(rows).select(n, F.when(good, short).otherwise(none).alias("value"), F.concat(text, key, assign).alias("left"), close.alias("right"))
    where = pick("path", ("docs", "web", "src/app.py", "config/.env", "code", "crawl", "tests/test_app.py", "examples/a.md"))
    lines = made.unionByName(more).select("value", where.alias("path"), good.alias("good"), F.concat("left", "value", "right", F.lit(" and the rest\n")).alias("text"))
    cut = candidates(lines).select("*", F.explode(_numbers()).alias("i"))
    left, right = _sides(F.col("i"))
    cut = cut.select(_part(F.col("i"), 3).alias("found"), F.col("value").alias("made"), left.alias("left"), right.alias("right"), "path", "good")
    label = F.when(F.col("good") & F.col("found").contains(F.col("made")), 1.0).when(~F.col("good"), 0.0)
    return cut.select(F.col("found").alias("value"), "left", "right", "path", label.alias("label")).filter("label IS NOT NULL")


class Forest:
    """A fitted forest as nested (feature, threshold, left, right) nodes and vote leaves."""

    def __init__(self, trees: list):
        self.trees = trees

    @classmethod
    def fit(cls, findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 17) -> Forest:
        """On labelled findings: value, left, right, path, label (1.0: a secret). Needs both labels."""
        inputs = features(F.col("value"), F.col("left"), F.col("right"), F.col("path"))
        rows = findings.select("label", *(c.alias(k) for k, c in inputs.items()))
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label").coalesce(1).cache()  # the fit goes over them many times
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=4, featureSubsetStrategy="onethird").fit(rows)
        rows.unpersist()

        def walk(node):
            if node.subtreeDepth() == 0:
                return float(node.prediction())
            split = node.split()
            return (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))

        return cls([walk(t._call_java("rootNode")) for t in model.trees])

    def score(self, inputs: Column) -> Column:
        """Share of trees that vote for a secret, for a struct of FEATURES."""

        def vote(node):
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(inputs[FEATURES[feature]] <= threshold, vote(left)).otherwise(vote(right))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + vote(t)
        return total / len(self.trees)


def marked(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = None, own: str = "__") -> DataFrame:
    """docs with pieces (see candidates()) and found (value, score of each candidate). Features and scores are computed once a candidate."""
    path = F.lit("") if path_col is None else string_col(docs, path_col)
    cut = candidates(docs, text_col, own)

    def one(i):
        value = _part(i, 3, own)
        left, right = _sides(i, own)
        return F.struct(value.alias("value"), *(c.alias(k) for k, c in features(value, left, right, path).items()))

    known = _once(cut, **{f"{own}known": F.transform(_numbers(own), one)})
    return _once(known, **{f"{own}found": F.transform(f"{own}known", lambda x: F.struct(x["value"].alias("value"), forest.score(x).alias("score")))}).drop(f"{own}known")


def findings(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """id, start (code points from 0), value, score of each secret, whatever its length. Null and empty texts hold none; repeated rows give theirs each, ids may be null, an empty table gives an empty one."""
    cols = {c: F.col(f"`{c}`") for c in dict.fromkeys((id_col, text_col, *([path_col] if path_col else [])))}
    rows = marked(docs.select(*cols.values()), forest, text_col, path_col).filter(F.exists("__found", lambda x: x["score"] >= threshold))
    # where pieces begin: sums over chunks of pieces, so long texts don't sum all pieces before for each candidate
    size = _once(rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), "__found", F.transform("__pieces", lambda x: F.length(x).cast("long")).alias("size")), chunk=F.transform(F.sequence(F.lit(0), F.floor(F.size("size") / CHUNK).cast("int")), lambda k: F.aggregate(F.slice("size", k * CHUNK + 1, F.lit(CHUNK)), F.lit(0).cast("long"), lambda a, x: a + x)))
    found = size.select("id", "size", "chunk", F.posexplode("__found").alias("i", "f")).filter(F.col("f.score") >= threshold)
    n = F.col("i") * STEP + 3  # pieces before the value
    total = lambda name, first, count: F.aggregate(F.slice(name, first, count), F.lit(0).cast("long"), lambda a, x: a + x)
    start = total("chunk", F.lit(1), F.floor(n / CHUNK).cast("int")) + total("size", F.floor(n / CHUNK).cast("int") * CHUNK + 1, n % CHUNK)
    return found.select("id", start.alias("start"), F.col("f.value").alias("value"), F.col("f.score").alias("score"))


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = None, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """docs with every secret replaced by the mask, whatever its length. A null text stays null; a text without secrets stays as it is, byte for byte. Columns may have any names."""
    own = _free(docs.columns)
    rows = marked(docs, forest, text_col, path_col, own)
    masked = F.transform(f"{own}pieces", lambda x, at: F.when((at % STEP == 3) & (F.get(F.col(f"{own}found"), F.floor(at / STEP).cast("int"))["score"] >= threshold), mask).otherwise(x))
    some = F.exists(f"{own}found", lambda x: x["score"] >= threshold)
    return rows.withColumn(text_col, F.when(some, F.array_join(masked, "")).otherwise(F.col(f"`{text_col}`"))).drop(f"{own}pieces", f"{own}found")
