"""The 14 rules over syntax-tree facts: each a list of cases, conditions on one fact of a kind, on one line, or on the whole file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.functions.lines import strip

# Fixed names.
RANDOM = ("random", "randint", "choice", "uniform", "shuffle", "sample", "randrange")
HTTP_CALLS = tuple(f"requests.{m}" for m in ("get", "post", "put", "patch", "delete", "head", "options", "request"))
DECODERS = ("base64.b64decode", "base64.urlsafe_b64decode", "base64.decodestring", "zlib.decompress", "bz2.decompress", "codecs.decode")
DECODE = r"(?U)(?:base64\.(?:b64decode|urlsafe_b64decode|decodestring)|zlib\.decompress|bz2\.decompress|codecs\.decode)\s*\("
EXECUTE = r"(?U)(?:exec|eval)\s*\("
REACH = 5


@dataclass(frozen=True)
class FactCase:
    """kind: of the facts that `when` looks at. extra: a text of the fact that takes the place of {} in the description."""

    kind: str
    when: Callable[[Column], Column]
    severity: str
    description: str
    cwe_id: str = ""
    extra: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class LineCase:
    """when: a condition on the stripped line and on whether the file parsed. after: its findings follow the facts' findings."""

    when: Callable[[Column, Column], Column]
    severity: str
    description: str
    after: bool = False


@dataclass(frozen=True)
class TreeRule:
    ordinal: int
    name: str
    cwe_id: str
    cwe_name: str
    needs: tuple[str, ...]  # of which a file with a finding holds one, if it is in ASCII
    cases: tuple[FactCase, ...]
    lines: tuple[LineCase, ...] = ()
    confidence: str = "HIGH"


def _keyword(call: Column, name: str) -> Column:
    return F.array_contains(call["kws"], name)


def _random(call: Column) -> Column:
    parts = F.split(call["full"], r"\.")
    return call["full"].startswith("random.") & ~call["full"].isin("random.SystemRandom", "random.secrets") & F.coalesce(F.get(parts, F.lit(1)), F.lit("")).isin(*RANDOM)


def _evaluates(call: Column) -> Column:
    return call["full"].isin("eval", "exec") | ((call["full"] == "compile") & call["by_name"] & call["dynamic"])


def decode_chains(lines: Column) -> Column:
    """Array of (decoded, executed) line numbers: each execution takes the last unused decoding at most five lines above or on it."""
    flagged = F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("line"), (~strip(x).startswith("#") & x.rlike(DECODE)).alias("decodes"), (~strip(x).startswith("#") & x.rlike(EXECUTE)).alias("runs")))
    told = F.filter(flagged, lambda x: x["decodes"] | x["runs"])
    ints, pairs = "array<int>", "array<struct<decoded: int, executed: int>>"
    start = F.struct(F.array().cast(ints).alias("open"), F.array().cast(pairs).alias("found"))

    def step(state: Column, x: Column) -> Column:
        opened = F.when(x["decodes"], F.concat(state["open"], F.array(x["line"]))).otherwise(state["open"])
        last = F.try_element_at(opened, F.lit(-1))
        hit = x["runs"] & last.isNotNull() & (x["line"] - last <= REACH)
        pair = F.array(F.struct(last.alias("decoded"), x["line"].alias("executed")))
        return F.struct(F.when(hit, F.slice(opened, 1, F.size(opened) - 1)).otherwise(opened).alias("open"), F.when(hit, F.concat(state["found"], pair)).otherwise(state["found"]).alias("found"))

    return F.aggregate(told, start, step)["found"]


def _hub(call: Column) -> Column:
    return call["last"].isin("from_pretrained", "load_dataset", "pipeline")


_CODE, _PICKLED = "Code Injection", "Deserialization of Untrusted Data"
_HIDDEN, _TRUSTED = "A broad handler hides the exception", "trust_remote_code=True"
_PINNED = "Model code or weights aren't pinned"

TREE_RULES: tuple[TreeRule, ...] = (
    TreeRule(2, "eval_exec", "CWE-94", _CODE, ("eval", "exec", "compile", "__import__"), (
        FactCase("call", lambda c: c["full"] == "__import__", "HIGH", "Runs code or modules named at run time"),
        FactCase("call", _evaluates, "CRITICAL", "Runs code or modules named at run time"))),
    TreeRule(17, "insufficient_logging", "CWE-778", "Insufficient Logging", ("except",), (
        FactCase("handler", lambda h: h["broad"] & ~h["diagnostic"], "LOW", _HIDDEN),), (
        LineCase(lambda code, parsed: ~parsed & code.rlike(r"(?U)^except\s*(?::|Exception\s*:)"), "LOW", _HIDDEN),)),
    TreeRule(22, "insecure_random", "CWE-338", "Weak Random Numbers", ("random",), (FactCase("call", _random, "LOW", "Not a source for secrets"),)),
    TreeRule(29, "format_string", "CWE-134", "Format String from Outside", ("format",), (FactCase("call", lambda c: (c["full"] == "str.format") & c["dynamic"], "MEDIUM", "The format itself may come from outside"),)),
    TreeRule(31, "insecure_default", "CWE-453", "Insecure Default", ("allow_pickle",), (FactCase("pickle", lambda p: F.lit(True), "HIGH", "allow_pickle is switched on"),)),
    TreeRule(39, "request_timeout", "CWE-1088", "Remote Call without Timeout", ("requests",), (FactCase("call", lambda c: c["full"].isin(*HTTP_CALLS) & ~_keyword(c, "timeout"), "HIGH", "The request may wait for ever"),)),
    TreeRule(40, "torch_load", "CWE-502", _PICKLED, ("torch",), (FactCase("call", lambda c: (c["full"] == "torch.load") & ~_keyword(c, "weights_only=True"), "CRITICAL", "A model is unpickled in full"),)),
    TreeRule(42, "except_pass", "CWE-391", "Unchecked Error Condition", ("except",), (FactCase("handler", lambda h: h["only"].isNotNull(), "MEDIUM", "The handler's only statement is {}", extra=lambda h: h["only"]),)),
    TreeRule(43, "pandas_eval", "CWE-94", _CODE, ("eval", "query"), (
        FactCase("call", lambda c: c["full"].isin("pandas.eval", "pd.eval"), "CRITICAL", "Evaluates an expression"),
        FactCase("call", lambda c: ~c["full"].isin("pandas.eval", "pd.eval") & c["by_attr"] & c["last"].isin("eval", "query"), "HIGH", "Evaluates an expression"))),
    TreeRule(44, "numpy_load", "CWE-502", _PICKLED, ("allow_pickle",), (FactCase("call", lambda c: c["full"].isin("numpy.load", "np.load") & _keyword(c, "allow_pickle=True"), "HIGH", "Object arrays are unpickled"),)),
    TreeRule(49, "parquet_arrow_deserialize", "CWE-502", _PICKLED, ("__arrow_ext_deserialize__", "cloudpickle.load"), (
        FactCase("def", lambda d: d["name"] == "__arrow_ext_deserialize__", "CRITICAL", "An extension type deserialises metadata"),), (
        LineCase(lambda code, parsed: code.rlike(r"(?U)cloudpickle\.loads?\s*\(") & F.lower(code).rlike(r"(?:py)?arrow|parquet|arrow_ext|deserialize"), "CRITICAL", "Columnar metadata is unpickled", after=True),)),
    TreeRule(52, "decode_exec_chains", "CWE-94", _CODE, ("exec", "eval"), (
        FactCase("call", lambda c: c["full"].isin("exec", "eval") & c["by_name"] & F.coalesce(c["inner"].isin(*DECODERS), F.lit(False)), "CRITICAL", "Decoded data is executed at once"),)),
    TreeRule(56, "huggingface_unsafe_download", "CWE-94", "Untrusted Model Download", ("from_pretrained", "load_dataset", "pipeline"), (
        FactCase("call", lambda c: _hub(c) & _keyword(c, _TRUSTED), "CRITICAL", _PINNED),
        FactCase("call", lambda c: (c["last"] == "from_pretrained") & ~_keyword(c, _TRUSTED) & ~_keyword(c, "revision"), "MEDIUM", _PINNED, "CWE-1104"))),
    TreeRule(57, "unbounded_pydantic_field", "CWE-770", "Allocation without Limits", ("BaseModel",), (FactCase("field", lambda f: F.lit(True), "MEDIUM", "{} has no greatest length", extra=lambda f: F.concat(f["name"], F.lit(": "), f["base"])),), confidence="MEDIUM"),
)
