"""A source corpus made from the driver's orders table and our own snippets, on Spark and in DuckDB alike.

Order k holds snippet k mod N. Paths come from order and customer keys by integer arithmetic and concatenation only. The rows that rules over
syntax trees should find are written down by hand beside each snippet; text rules are recomputed by SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.predicates import sql_text


@dataclass(frozen=True)
class Snippet:
    text: str
    #: (rule, cwe_id, severity, line) of rules that need the tree or the whole file, and the snippet where it isn't the stripped line;
    #: of one rule in the order of its report
    expect: tuple[tuple, ...] = ()
    label: str = ""  # a file name, where the snippet isn't a module
    locked: bool = False
    tests: tuple[str, ...] = field(default=(), compare=False)


def _s(text: str, *expect: tuple, label: str = "", locked: bool = False) -> Snippet:
    return Snippet(text, expect, label, locked)


SNIPPETS: tuple[Snippet, ...] = (
    _s("import os\n\n\ndef add(a, b):\n    return a + b\n"),
    _s("import pickle\nstate = pickle.loads(blob)\nother = cloudpickle.loads(blob)\n"),
    _s("x = dill.load(f)\ny = joblib.load('m.pkl')\nz = shelve.open('db')\nw = marshal.loads(b)\nu = pickle.Unpickler(f)\n"),
    _s("import os\nos.system('ls')\nos.popen('ls')\n"),
    _s("subprocess.run(cmd, shell=True)\n# subprocess.run(cmd, shell = True)\nsubprocess.Popen(cmd)\npty.spawn('sh')\n"),
    _s("def q(db, name):\n    db.execute(f\"select {name}\")\n", ("sql_injection", "CWE-89", "CRITICAL", 2)),
    _s("TABLE = 'users'\n\n\ndef q(db):\n    db.execute(f\"select * from {TABLE}\")\n"),
    _s("def q(db, name):\n    db.exec_driver_sql(f\"drop {name}\")\n    db.execute('a' + name)\n", ("sql_injection", "CWE-89", "CRITICAL", 2), ("exec_driver_sql", "CWE-89", "CRITICAL", 2), ("sql_injection", "CWE-89", "CRITICAL", 3)),
    _s("from sqlalchemy import text\nNAME = 'x'\nbind.exec_driver_sql(f\"drop {NAME}\")\n"),
    _s("p = path.lstrip('/')\nf = open (relative_path)\n"),
    _s("password = 'hunter22'\nPASSWORD: 'abcd'\nprivate_key = 'MIIE'\npwd = 'example-pwd'\n"),
    _s("connection_url = 'pg://u:p@host/db'\nconnection_url = f'pg://{u}:{p}@h'\n"),
    _s("yaml.load(f)\nyaml.load(f, Loader=yaml.CSafeLoader)\nyaml.unsafe_load(f)\n"),
    _s("import xml.etree.ElementTree as ET\ntree = ET.parse(f)\n", ("xxe", "CWE-611", "HIGH", 1)),
    _s("from lxml import etree\n\n\ndoc = etree.parse(f)\np = etree.XMLParser()\nsubetree.x()\n", ("xxe", "CWE-611", "HIGH", 4), ("xxe", "CWE-611", "HIGH", 5)),
    _s("import lxml.etree as LX\nLX.parse(f)\n# LX.parse(g)\n", ("xxe", "CWE-611", "HIGH", 2)),
    _s("import requests\n\n\ndef get(url):\n    return requests.get(url)\n", ("ssrf", "CWE-918", "HIGH", 5), ("request_timeout", "CWE-1088", "HIGH", 5)),
    _s("import requests\nBASE = 'http://127.0.0.1'\nrequests.get(BASE + '/x', timeout=3)\nrequests.request('GET', url)\n", ("request_timeout", "CWE-1088", "HIGH", 4)),
    _s("import httpx\n\n\nasync def go(url):\n    async with httpx.AsyncClient() as client:\n        await client.get(url)\n        await client.get('http://a')\n", ("ssrf", "CWE-918", "HIGH", 6)),
    _s("def go(session, pk):\n    session.get(Model, pk)\n\n\ndef web(u):\n    session = requests.Session()\n    session.post(u)\n", ("ssrf", "CWE-918", "HIGH", 7)),
    _s("def build(u):\n    return u\n\n\ndef go(path):\n    urllib.request.urlopen(build('http://a'))\n    urllib.request.urlopen(build(path))\n", ("ssrf", "CWE-918", "HIGH", 7)),
    _s("tempfile.mktemp()\nos.symlink(a, b)\np.symlink_to(q)\n"),
    _s("re.compile(r'(a+)+')\nre.match('(b*)*c', x)\n"),
    _s("assert role is admin\nassert user.role == 'admin'\nassert isinstance(role, in_admin)\nassert x in owner\n"),
    _s("pip install --extra-index-url http://x\ndebug=True\napp.run(debug = True)  # docstring\n"),
    _s("if token == 'abc':\n    pass\nif name == \"b\" and auth:\n    pass\n"),
    _s("traceback.print_exc()\ntraceback.print_exception(e)\n"),
    _s("s = 'a\\x00b'\nt = '\\0'\ndata = f.read()\nmore = f.read(10)\nchunk = stream.read()\n"),
    _s("Template(x)\njinja = Jinja2.Template (y)\nh = 'a\\r\\nb'\nu = '%0d%0a'\n"),
    _s("c = ldap.initialize(u)\nimport ldap3\n"),
    _s("h = hashlib.md5(x)\ng = hashlib.new('SHA1', y)\nk = hashlib.md5(token).hexdigest()\n"),
    _s("return redirect(u)\nreturn HttpResponseRedirect (u)\n"),
    _s("log.info(f\"user {u}\")\nlog.info(f\"user {u!r}\")\nlog.error(f'{x!r}')\nlogger.warning('p %s', password)\n"),
    _s("shutil.copy(a, b)\nshutil.copyfile(a, b)\nos.rename(a, b)\n"),
    _s("requests_verify(verify=False)\nctx.check_hostname = False\nssl.CERT_NONE\nssl._create_unverified_context()\n"),
    _s("z.extractall(d)\nz.extractall(d.resolve())\n"),
    _s("api_key = 'ABCDEFGHIJKLMNOP1234'\nAPI_KEY = \"abcdefghijklmnop=\"\ntoken = 'aaaaaaaaaaaaaaaaaaaaaa.bbb.ccc'\nclient_secret = 'abcdEFGH12345678+/'\nauth_token = 'your-token-goes-here-now'\n"),
    _s("from Crypto.Cipher.DES import new\nARC4.new(k)\nAES.new(k, AES.MODE_ECB)\nPKCS1_v1_5.new(k)\n"),
    _s("c.set_missing_host_key_policy(AutoAddPolicy())\nsshtunnel.open_tunnel(x)\nWarningPolicy\n"),
    _s("pd.read_pickle(f)\nnumpy.ctypeslib.load_library('x.so', '.')\nnumpy.load('x.so')\npandas.read_xml(f)\npd.read_xml(f, parser='lxml')\n"),
    _s("site.addsitedir(d)\nwith open('a.pth') as f: exec(open('b.pth').read())\n", ("eval_exec", "CWE-94", "CRITICAL", 2), ("pth_startup_hooks", "CWE-829", "HIGH", 1), ("pth_startup_hooks", "CWE-829", "CRITICAL", 2)),
    _s("# path\n\nimport os; os.getcwd()\nprint(1)\n", ("pth_startup_hooks", "CWE-829", "CRITICAL", 3), label="hook.pth"),
    _s("m = torch.load('a.pt')\nn = torch.load('b.ckpt', weights_only=True)\nk = keras.models.load_model(p)\nj = joblib.load('c.joblib')\n", ("torch_load", "CWE-502", "CRITICAL", 1)),
    _s("app.run(host='0.0.0.0')\nnet = '0.0.0.0/0'\nssl.PROTOCOL_TLSv1\nssl.PROTOCOL_TLSv1_2\nfrom Crypto import Random\nfrom Cryptodome import Random\n"),
    _s("eval(x)\nexec('1')\ncompile(src, 'f', 'exec')\ncompile('1', 'f', 'exec')\n__import__(n)\nre.compile(p)\nmodel.eval()\n", ("eval_exec", "CWE-94", "CRITICAL", 1), ("eval_exec", "CWE-94", "CRITICAL", 2), ("eval_exec", "CWE-94", "CRITICAL", 3), ("eval_exec", "CWE-94", "HIGH", 5), ("pandas_eval", "CWE-94", "HIGH", 7)),
    _s("f().eval(x)\na[0].exec(x)\n", ("eval_exec", "CWE-94", "CRITICAL", 1), ("eval_exec", "CWE-94", "CRITICAL", 2), ("pandas_eval", "CWE-94", "HIGH", 1)),
    _s("try:\n    go()\nexcept Exception:\n    x = 1\ntry:\n    go()\nexcept:\n    log(1)\n", ("insufficient_logging", "CWE-778", "LOW", 3)),
    _s("try:\n    go()\nexcept Exception as e:\n    print(e)\ntry:\n    go()\nexcept Exception:\n    def f():\n        raise\n", ("insufficient_logging", "CWE-778", "LOW", 7)),
    _s("try:\n    go(\nexcept Exception:\n    pass\n", ("insufficient_logging", "CWE-778", "LOW", 3)),
    _s("for i in x:\n    try:\n        go()\n    except ValueError:\n        continue\ntry:\n    go()\nexcept (A, B):\n    pass\n", ("except_pass", "CWE-391", "MEDIUM", 8), ("except_pass", "CWE-391", "MEDIUM", 4)),
    _s("import random\nrandom.randint(1, 2)\nrandom.SystemRandom()\nrandom.seed(1)\nnp.random.choice(x)\n", ("insecure_random", "CWE-338", "LOW", 2)),
    _s("str.format(fmt, x)\nstr.format('a', 'b')\nfmt.format(x)\n", ("format_string", "CWE-134", "MEDIUM", 1)),
    _s("np.load(f,\n        allow_pickle=True)\nallow_pickle = True\nself.allow_pickle: bool = True\n\n\ndef f(a, allow_pickle=True, *, b=1):\n    return allow_pickle\n", ("insecure_default", "CWE-453", "HIGH", 3), ("insecure_default", "CWE-453", "HIGH", 4), ("insecure_default", "CWE-453", "HIGH", 7), ("insecure_default", "CWE-453", "HIGH", 2), ("numpy_load", "CWE-502", "HIGH", 1)),
    _s("pd.eval('a')\ndf.query(q)\ndb.session.query(M)\n", ("pandas_eval", "CWE-94", "CRITICAL", 1), ("pandas_eval", "CWE-94", "HIGH", 2), ("pandas_eval", "CWE-94", "HIGH", 3)),
    _s("class T:\n    def __arrow_ext_deserialize__(cls, t, b):\n        return cloudpickle.loads(b)  # arrow\n", ("parquet_arrow_deserialize", "CWE-502", "CRITICAL", 2), ("parquet_arrow_deserialize", "CWE-502", "CRITICAL", 3)),
    _s("import base64\nexec(base64.b64decode(p))\n", ("decode_exec_chains", "CWE-94", "CRITICAL", 2, "decode at line 2, exec at line 2"), ("decode_exec_chains", "CWE-94", "CRITICAL", 2), ("eval_exec", "CWE-94", "CRITICAL", 2)),
    _s("a = zlib.decompress(x)\nb = bz2.decompress(y)\nexec(b)\neval(a)\neval(c)\n", ("decode_exec_chains", "CWE-94", "CRITICAL", 3, "decode at line 2, exec at line 3"), ("decode_exec_chains", "CWE-94", "CRITICAL", 4, "decode at line 1, exec at line 4"), ("eval_exec", "CWE-94", "CRITICAL", 3), ("eval_exec", "CWE-94", "CRITICAL", 4), ("eval_exec", "CWE-94", "CRITICAL", 5)),
    _s("a = codecs.decode(x)\n\n\n\n\n\n# exec(a)\nv = ast.literal_eval(a)\n"),
    _s("M.from_pretrained('a')\nM.from_pretrained('a', revision='1')\npipeline('t', trust_remote_code=True)\nload_dataset('d')\n", ("huggingface_unsafe_download", "CWE-1104", "MEDIUM", 1), ("huggingface_unsafe_download", "CWE-94", "CRITICAL", 3)),
    _s("class LoginRequest(BaseModel):\n    name: str\n    bio: Optional[str] = None\n    raw: bytes | None = None\n    n: int = 0\n    ok: str = Field(max_length=3)\n    tag: Annotated[str, StringConstraints(max_length=3)]\n\n\nclass Config(BaseModel):\n    name: str\n", ("unbounded_pydantic_field", "CWE-770", "MEDIUM", 2), ("unbounded_pydantic_field", "CWE-770", "MEDIUM", 3), ("unbounded_pydantic_field", "CWE-770", "MEDIUM", 4)),
    _s("requests==2.31.0\nurllib3 >= 1.26.5\nacme-dask==2023.1.0\ndask<2024.1.0\nnumpy==1.0\n", ("dependency_cve", "CWE-1104", "HIGH", 2), ("dependency_cve", "CWE-1104", "HIGH", 1), ("dependency_cve", "CWE-1104", "HIGH", 4), label="requirements.txt"),
    _s("[project]\nrequires-python = '>=3.10'\ndependencies = [\n  \"flask>=2.0\",\n  \"pandas>=2.1.0,<3\",\n  'werkzeug>=3.0.1',\n]\n", ("unbounded_pins", "CWE-1104", "LOW", 4), ("unbounded_pins", "CWE-1104", "LOW", 6), ("dependency_cve", "CWE-1104", "HIGH", 6), ("dependency_cve", "CWE-1104", "HIGH", 5), label="pyproject.toml"),
    _s("[packages]\n# 'a>=1.0'\nx = 'aiohttp>=3.9.0'\n'python>=3.8'\n", ("unbounded_pins", "CWE-1104", "INFO", 3), ("dependency_cve", "CWE-1104", "HIGH", 3), label="Pipfile", locked=True),
    _s("x = pickle.loads(b)  # nosec\ny = pickle.loads(b)  # nosec CWE-502, CWE-94\nz = pickle.loads(b)  # nosec cwe-94\nw = pickle.loads(b)  # nosec -- reason\n"),
    _s("password = 'letmein9'\nassert x in owner\n"),
    _s("x = 'a\u202eb'\n# \u2066c\ny = 'é'\n", ("trojan_source", "CWE-1007", "CRITICAL", 1, "\"x = 'a\\u202eb'\""), ("trojan_source", "CWE-1007", "CRITICAL", 2, "'# \\u2066c'")),
    _s("eval(x)\ntry:\n  a()\nexcept A:\n  pass\n", label="setup.cfg"),
    _s("def f(x):\n    return [i for i in x if i]\n"),
)


def snippets(spark: SparkSession) -> DataFrame:
    rows = [(k, s.text, s.label, s.locked) for k, s in enumerate(SNIPPETS)]
    return spark.createDataFrame(rows, "snippet_id long, text string, label string, locked boolean")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, package, text, locked: one file for each order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    if orders.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # one small file would leave the scan to one core
        orders = orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    rows = orders.withColumn("snippet_id", F.col("o_orderkey") % len(SNIPPETS)).join(F.broadcast(snippets(spark)), "snippet_id")  # a fixed number of snippets
    package = F.concat(F.lit("pkg"), (F.col("o_custkey") % 5).cast("string"))
    folder = F.when(F.col("o_orderkey") % 11 == 0, "/tests/").otherwise("/")
    name = F.when(F.col("label") == "", F.concat(F.lit("mod_"), F.col("o_orderkey").cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("d"), F.col("o_orderkey").cast("string"), F.lit("/"), F.col("label")))
    return rows.select(F.concat(package, folder, name).alias("path"), package.alias("package"), "text", "locked", "snippet_id")


def files_sql() -> str:
    """WITH clauses for DuckDB: snippets, files, and lines (path, package, snippet_id, number, line, code)."""
    values = ",\n".join(f"({k}, {sql_text(s.text)}, {sql_text(s.label)}, {str(s.locked).lower()})" for k, s in enumerate(SNIPPETS))
    return f"""snippets(snippet_id, text, label, locked) AS (VALUES {values}),
files AS (
  SELECT 'pkg' || (o_custkey % 5) || CASE WHEN o_orderkey % 11 = 0 THEN '/tests/' ELSE '/' END ||
    CASE WHEN label = '' THEN 'mod_' || o_orderkey || '.py' ELSE 'd' || o_orderkey || '/' || label END AS path,
    'pkg' || (o_custkey % 5) AS package, text, locked, snippet_id
  FROM orders JOIN snippets ON o_orderkey % {len(SNIPPETS)} = snippet_id
),
lines AS (
  SELECT path, package, snippet_id, number, line, trim(line, ' ' || chr(9)) AS code FROM (
    SELECT path, package, snippet_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS number, unnest(string_split(text, chr(10))) AS line FROM files
  )
)"""


def expected_sql() -> str:
    """A WITH clause for DuckDB: the rows written down beside the snippets, place: their order beside the snippet."""
    rows = [(k, place, *e, *([None] * (5 - len(e)))) for k, s in enumerate(SNIPPETS) for place, e in enumerate(s.expect)]
    values = ",\n".join(f"({k}, {place}, '{rule}', '{cwe}', '{severity}', {line}, {'NULL' if snippet is None else sql_text(snippet)})" for k, place, rule, cwe, severity, line, snippet in rows)
    return f"expected(snippet_id, place, rule, cwe_id, severity, line, snippet) AS (VALUES {values})"
