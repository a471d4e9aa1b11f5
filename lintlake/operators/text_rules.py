"""The 41 line rules: each a list of slots, each slot an ordered list of cases of which the first that holds gives a finding."""

from __future__ import annotations

from dataclasses import dataclass

from lintlake.functions.predicates import Fact, Has, Match, Predicate, Starts, any_of

LOG_METHODS = "debug|info|warning|warn|error|critical|exception|log"


@dataclass(frozen=True)
class Case:
    when: Predicate
    severity: str
    description: str


@dataclass(frozen=True)
class TextRule:
    ordinal: int
    name: str
    cwe_id: str
    cwe_name: str
    slots: tuple[tuple[Case, ...], ...]
    confidence: str = "MEDIUM"
    comments: bool = False  # also on comment lines
    files: str = ""  # "!pth": not in start-up files
    wide: bool = False  # holds only on lines with characters outside ASCII

    @property
    def needs_tree(self) -> bool:
        return "Fact(" in repr(self.slots)


def M(pattern: str) -> Match:
    return Match(pattern)


def I(pattern: str) -> Match:  # noqa: E743
    return Match(pattern, True)


#: Patterns, words, order, severities, CWE numbers and names of the rules as a whole.
#: A line that names a setting or a stand-in rather than a secret.
NOT_A_SECRET = any_of("environ", "getenv", "config", "your-", "placeholder", "...", "example", "xxxx", "****", lower=True) | (Has("connection_url", True) & any_of("{", "}", "dialect", lower=True))

# Calls that start commands, in order of precedence.
COMMANDS = ("os.system os.popen subprocess.call subprocess.Popen subprocess.run subprocess.check_output subprocess.getoutput subprocess.getstatusoutput os.execv os.execl os.execve os.execvp pty.spawn asyncio.create_subprocess_shell").split()


def _one(when: Predicate, severity: str, description: str) -> tuple[tuple[Case, ...], ...]:
    return ((Case(when, severity, description),),)


def _first(severity: str, description: str, *patterns: str, ignore_case: bool = False, unless: Predicate | None = None) -> tuple[Case, ...]:
    cases = (Match(p, ignore_case) for p in patterns)
    return tuple(Case(c & ~unless if unless else c, severity, description) for c in cases)


_LOADS = "Deserialises data with code execution as a side effect"

TEXT_RULES: tuple[TextRule, ...] = (
    TextRule(1, "pickle", "CWE-502", "Deserialization of Untrusted Data", (
        _first("CRITICAL", _LOADS, r"pickle\.loads?\s*\(", r"pickle\.Unpickler\s*\(", r"cloudpickle\.loads?\s*\(", r"dill\.loads?\s*\(")
        + _first("HIGH", _LOADS, r"joblib\.load\s*\(", r"shelve\.open\s*\(", r"marshal\.loads?\s*\("),)),
    TextRule(3, "command_injection", "CWE-78", "OS Command Injection", (
        tuple(Case(M(r"\b" + c.replace(".", r"\.") + r"\s*\("), "CRITICAL" if c in ("os.system", "os.popen") else "HIGH", f"{c} starts a command") for c in COMMANDS),
        (Case(M(r"shell\s*=\s*True"), "HIGH", "The command goes through a shell"),))),
    TextRule(4, "sql_injection", "CWE-89", "SQL Injection", (
        _first("CRITICAL", "SQL text is built from values", r"execute\s*\(\s*f[\"']", r"exec_driver_sql\s*\(\s*f[\"']", r"\.execute\s*\([^)]*\+", unless=Fact("safe_sql")),)),
    TextRule(5, "path_traversal", "CWE-22", "Path Traversal", (
        (Case(M(r"lstrip\(['\"]\/['\"]\)"), "HIGH", "Stripping a slash doesn't confine a path"),),
        (Case(Has("relative_path") & M(r"open\s*\("), "MEDIUM", "Opens a relative path as given"),))),
    TextRule(6, "hardcoded_secrets", "CWE-798", "Hard-coded Credentials", (
        _first("CRITICAL", "A key or address with credentials stands in the source", r"(?:private_key|ssh_key|pem)\s*[:=]\s*[\"'][^\"']+[\"']", r"connection_url\s*=\s*[\"'][^\"']*://[^\"']+:[^\"']+@", ignore_case=True, unless=NOT_A_SECRET)
        + _first("HIGH", "A password stands in the source", r"(?:password|passwd|pwd)\s*[:=]\s*[\"'][^\"']{4,}[\"']", ignore_case=True, unless=NOT_A_SECRET),)),
    TextRule(7, "yaml_deserialize", "CWE-502", "Deserialization of Untrusted Data", _one((M(r"yaml\.load\s*\(") & ~Has("SafeLoader")) | M(r"yaml\.unsafe_load\s*\("), "CRITICAL", "YAML is loaded with arbitrary objects")),
    TextRule(8, "xxe", "CWE-611", "XML External Entities", _one(M(r"(?:xml\.etree|xml\.dom|xml\.sax)\.") | Fact("lxml_use", ("lxml",)), "HIGH", "The parser may resolve external entities")),
    TextRule(9, "ssrf", "CWE-918", "Server-Side Request Forgery", _one(
        (~Fact("safe_http") & M(r"(?:requests|httpx)\.(?:delete|get|head|options|patch|post|put|request)\s*\(|urllib\.request\.urlopen\s*\(|aiohttp\.ClientSession")) | (Fact("session_call", ("Session", "Client")) & ~Fact("session_safe")), "HIGH", "The address of a request may come from outside")),
    TextRule(10, "tempfile", "CWE-377", "Insecure Temporary File", _one(Has("tempfile.mktemp"), "HIGH", "The name may be taken before the file is made")),
    TextRule(11, "symlink", "CWE-61", "Symlink Following", _one(any_of(".symlink_to", "os.symlink"), "MEDIUM", "Makes a symbolic link")),
    TextRule(12, "redos", "CWE-1333", "Inefficient Regular Expression", _one(M(r"re\.(?:compile|match|search)") & M(r"\([^)]+[+*?]\)[+*?{]"), "MEDIUM", "Nested repetition can take exponential time"), "LOW"),
    TextRule(13, "assert_security", "CWE-617", "Reachable Assertion", _one(Starts("assert ") & ~Has("isinstance") & M(r"\b(is|==|!=|in)\b") & I(r"(?:admin|owner|role|permission|authorized|authenticated)"), "MEDIUM", "Assertions vanish under -O"), comments=True),
    TextRule(14, "exec_driver_sql", "CWE-89", "SQL Injection", _one(M(r"exec_driver_sql\s*\(\s*f[\"']") & ~Fact("safe_driver"), "CRITICAL", "Driver-level SQL is built from values")),
    TextRule(15, "supply_chain", "CWE-1104", "Unmaintained Third Party Components", _one(Has("--extra-index-url"), "HIGH", "A second index allows dependency confusion")),
    TextRule(16, "debug_mode", "CWE-489", "Active Debug Code", _one(M(r"debug\s*=\s*True") & ~Has("docstring", True), "MEDIUM", "Debug mode is on"), "LOW"),
    TextRule(18, "timing_attack", "CWE-208", "Observable Timing Discrepancy", _one(M(r"==\s*['\"]") & I(r"(?:token|secret|password|auth)"), "LOW", "A secret is compared in variable time"), "LOW"),
    TextRule(19, "sensitive_exposure", "CWE-200", "Exposure of Sensitive Information", _one(any_of("traceback.print_exc", "traceback.print_exception"), "MEDIUM", "A stack trace is printed")),
    TextRule(20, "null_byte", "CWE-158", "Null Byte Injection", _one(M(r"\\x00|\\0"), "INFO", "A null byte is written out")),
    TextRule(21, "resource_limits", "CWE-770", "Allocation without Limits", _one(M(r"\.read\(\)") & ~M(r"read\(\d") & ~I(r"(?:chunk|iter_content|stream)"), "INFO", "Reads without a limit")),
    TextRule(23, "ssti", "CWE-1336", "Template Injection", _one(M(r"(?:Jinja2?\.Template|Template)\s*\("), "HIGH", "A template is made from text")),
    TextRule(24, "crlf", "CWE-93", "CRLF Injection", _one(M(r"\\r\\n|%0d%0a|%0D%0A"), "HIGH", "Line ends are put into a value")),
    TextRule(25, "ldap", "CWE-90", "LDAP Injection", _one(any_of("ldap.initialize", "ldap3"), "HIGH", "Queries a directory")),
    TextRule(26, "weak_hash", "CWE-328", "Weak Hash", (
        (Case(M(r"hashlib\.(?:md5|sha1)\s*\("), "MEDIUM", "A broken hash function"),),
        (Case(I(r"hashlib\.new\s*\(\s*[\"'](?:md5|md4|md2|sha1)[\"']"), "MEDIUM", "A broken hash function by name"),))),
    TextRule(27, "open_redirect", "CWE-601", "Open Redirect", _one(M(r"(?:redirect|Redirect)\s*\("), "MEDIUM", "Redirects to a given address")),
    TextRule(28, "log_injection", "CWE-117", "Log Injection", _one(M(rf"\.(?:{LOG_METHODS})\s*\(\s*f[\"']") & ~M(r"%[srd]|\{!r\}|\{!s\}"), "LOW", "Values are formatted into a log line")),
    TextRule(30, "arbitrary_write", "CWE-73", "External Control of File Name", _one(M(r"(?:shutil\.copy|shutil\.move|os\.rename)\s*\("), "MEDIUM", "Writes to a given path")),
    TextRule(32, "log_secrets", "CWE-532", "Secrets in Logs", _one(M(rf"\.(?:{LOG_METHODS})\s*\(") & I(r"(password|passwd|secret|token|api_key|apikey|auth_token|access_key|private_key)"), "HIGH", "A secret may be logged")),
    TextRule(33, "tls_verify", "CWE-295", "Improper Certificate Validation", (_first("CRITICAL", "Certificates aren't checked", r"verify\s*=\s*False", r"check_hostname\s*=\s*False", "CERT_NONE", "_create_unverified_context"),)),
    TextRule(34, "zipslip", "CWE-22", "Path Traversal in Archives", _one(M(r"\.extractall\s*\(") & ~M(r"(resolve|is_relative_to|member.*safe)"), "HIGH", "Members may leave the target folder")),
    TextRule(35, "hardcoded_tokens", "CWE-798", "Hard-coded Credentials", (
        _first("CRITICAL", "A token stands in the source", r"(?:api_key|apikey)\s*[:=]\s*[\"'][A-Za-z0-9_\-=]{16,}[\"']", r"(?:token|jwt)\s*[:=]\s*[\"'][A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+[\"']", r"(?:bearer|auth_token)\s*[:=]\s*[\"'][A-Za-z0-9_\-]{20,}[\"']", r"(?:secret|client_secret)\s*[:=]\s*[\"'][A-Za-z0-9_\-+/=]{16,}[\"']", ignore_case=True, unless=NOT_A_SECRET),)),
    TextRule(36, "weak_crypto", "CWE-327", "Broken Cryptography", (
        _first("HIGH", "A broken cipher, mode or padding", r"Crypto\.Cipher\.DES\b|pycryptodome.*DES\b", r"ARC4\b|RC4\b", r"MODE_ECB\b", r"PKCS1_v1_5\b", r"hashlib\.md5\b.*\b(?:sign|hmac|sig|token|password|hash\b)", ignore_case=True),)),
    TextRule(38, "trojan_source", "CWE-1007", "Trojan Source", _one(M("[\u202a-\u202e\u2066-\u2069]"), "CRITICAL", "Direction marks reorder what is shown"), comments=True, wide=True),
    TextRule(41, "ssh_host_key", "CWE-322", "Unverified Host Key", (_first("HIGH", "Any host key is taken", "AutoAddPolicy", "WarningPolicy", r"sshtunnel\.open_tunnel"),)),
    TextRule(45, "pandas_pickle", "CWE-502", "Deserialization of Untrusted Data", _one(M(r"(?:pd|pandas)\.read_pickle\s*\("), "CRITICAL", "A pickled frame is loaded")),
    TextRule(46, "numpy_load_lib", "CWE-114", "Process Control", _one(M(r"numpy\.(?:load|ctypeslib)\.") & M(r"\.(so|dll|dylib)"), "HIGH", "Loads a native library")),
    TextRule(47, "pandas_xml_xxe", "CWE-611", "XML External Entities", _one(M(r"(?:pd|pandas)\.read_xml\s*\(") & ~Has("parser"), "HIGH", "The default parser resolves entities")),
    TextRule(48, "pth_startup_hooks", "CWE-829", "Code from an Untrusted Sphere", (
        (Case(M(r"site\.addsitedir\s*\("), "HIGH", "Start-up files of a folder are run"),),
        (Case(M(r"exec\s*\(\s*(?:compile|open|base64)") & M(r"\.pth"), "CRITICAL", "Code is run from a start-up file"),)), files="!pth"),
    TextRule(51, "model_file_load", "CWE-502", "Deserialization of Untrusted Data", (
        (Case(M(r"torch\.load\s*\(") & M(r"\.(?:pt|pth|ckpt)[\"']") & Has("weights_only"), "LOW", "Model weights are loaded"), Case(M(r"torch\.load\s*\(") & M(r"\.(?:pt|pth|ckpt)[\"']"), "CRITICAL", "A pickled model is loaded")),
        (Case(M(r"(?:joblib|pickle|cloudpickle|dill)\.load\s*\(") & M(r"\.(?:pt|pkl|h5|joblib|ckpt)[\"']"), "HIGH", "A pickled model is loaded"),),
        (Case(M(r"(?:tf|keras)\.(?:models\.)?load_model\s*\("), "HIGH", "A model with code is loaded"),))),
    TextRule(53, "bind_all_interfaces", "CWE-1327", "Binding to All Interfaces", _one(M(r"[\"']0\.0\.0\.0[\"']"), "MEDIUM", "Listens on every interface")),
    TextRule(54, "weak_tls_version", "CWE-326", "Inadequate Encryption Strength", _one(M(r"PROTOCOL_(?:SSLv2|SSLv3|TLSv1)\b"), "HIGH", "An old protocol version")),
    TextRule(55, "legacy_pycrypto", "CWE-1104", "Unmaintained Third Party Components", _one(M(r"^(?:from|import)\s+Crypto\b"), "MEDIUM", "The package is no longer maintained")),
)
