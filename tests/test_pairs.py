"""For each rule a source that it must find (line and severity written by hand) and one close to it that it must not."""

import pytest

from lintlake.operators.text_rules import TEXT_RULES
from lintlake.operators.tree_rules import TREE_RULES
from lintlake.plans import scan

# rule: (source, [(line, severity)], a source without findings of the rule)
PAIRS = {
    "pickle": ("import pickle\ndata = pickle.load(handle)\n", [(2, "CRITICAL")], "data = json.load(handle)\npickle.dumps(data)\n"),
    "eval_exec": ("def run(text):\n    return eval(text)\n", [(2, "CRITICAL")], "def run(text):\n    return ast.literal_eval(text)\n"),
    "command_injection": ("subprocess.check_output(cmd)\n", [(1, "HIGH")], "subprocess_result = output(cmd)\n"),
    "sql_injection": ('def find(cur, name):\n    cur.execute("select * from t where n = " + name)\n', [(2, "CRITICAL")], 'def find(cur, name):\n    cur.execute("select * from t where n = ?", (name,))\n'),
    "path_traversal": ("target = name.lstrip('/')\n", [(1, "HIGH")], "target = name.strip('/')\n"),
    "hardcoded_secrets": ("password = 'correct-horse'\n", [(1, "HIGH")], "password = os.environ['PASSWORD']\npassword = 'abc'\n"),
    "yaml_deserialize": ("conf = yaml.load(stream)\n", [(1, "CRITICAL")], "conf = yaml.load(stream, Loader=yaml.SafeLoader)\nconf = yaml.safe_load(stream)\n"),
    "xxe": ("from xml.dom import minidom\ndoc = xml.dom.minidom.parse(f)\n", [(2, "HIGH")], "from defusedxml import ElementTree\ndoc = ElementTree.parse(f)\n"),
    "ssrf": ("def fetch(url):\n    return httpx.get(url)\n", [(2, "HIGH")], "def fetch():\n    return httpx.get('https://service.example/health')\n"),
    "tempfile": ("name = tempfile.mktemp()\n", [(1, "HIGH")], "handle = tempfile.mkstemp()\n"),
    "symlink": ("os.symlink(source, target)\n", [(1, "MEDIUM")], "os.link(source, target)\n"),
    "redos": ("rule = re.compile(r'(x+)+$')\n", [(1, "MEDIUM")], "rule = re.compile(r'x+$')\n"),
    "assert_security": ("assert role is wanted_role\n", [(1, "MEDIUM")], "assert isinstance(role, str) and role is x\nassert size is known\n"),
    "exec_driver_sql": ("def f(c, t):\n    c.exec_driver_sql(f'drop table {t}')\n", [(2, "CRITICAL")], "def f(c):\n    c.exec_driver_sql('drop table t')\n"),
    "supply_chain": ("run('pip install --extra-index-url https://x y')\n", [(1, "HIGH")], "run('pip install --index-url https://x y')\n"),
    "debug_mode": ("app.run(debug=True)\n", [(1, "MEDIUM")], "app.run(debug=False)\n"),
    "insufficient_logging": ("try:\n    go()\nexcept Exception:\n    done = False\n", [(3, "LOW")], "try:\n    go()\nexcept Exception:\n    logger.exception('failed')\n"),
    "timing_attack": ("ok = token == 'expected'\n", [(1, "LOW")], "ok = hmac.compare_digest(token, expected)\n"),
    "sensitive_exposure": ("traceback.print_exc()\n", [(1, "MEDIUM")], "text = traceback.format_exc()\n"),
    "null_byte": ("name = 'a\\x00b'\n", [(1, "INFO")], "name = 'a\\x01b'\n"),
    "resource_limits": ("body = upload.read()\n", [(1, "INFO")], "body = upload.read(4096)\nfor c in r.iter_content(): c.read()\n"),
    "insecure_random": ("import random\ncode = random.choice(letters)\n", [(2, "LOW")], "import secrets\ncode = secrets.choice(letters)\n"),
    "ssti": ("page = Template(text)\n", [(1, "HIGH")], "page = env.get_template('a.html')\n"),
    "crlf": ("head = name + '\\r\\n'\n", [(1, "HIGH")], "head = name + '\\n'\n"),
    "ldap": ("link = ldap.initialize(server)\n", [(1, "HIGH")], "link = directory.initialize(server)\n"),
    "weak_hash": ("key = hashlib.sha1(data)\n", [(1, "MEDIUM")], "key = hashlib.sha256(data)\n"),
    "open_redirect": ("return redirect(request.args['next'])\n", [(1, "MEDIUM")], "return redirected\n"),
    "log_injection": ("logger.warning(f'user {name}')\n", [(1, "LOW")], "logger.warning('user %s', name)\n"),
    "format_string": ("str.format(template, user)\n", [(1, "MEDIUM")], "'{}'.format(user)\n"),
    "arbitrary_write": ("shutil.move(source, target)\n", [(1, "MEDIUM")], "shutil.disk_usage(target)\n"),
    "insecure_default": ("def load(path, allow_pickle=True):\n    pass\n", [(1, "HIGH")], "def load(path, allow_pickle=False):\n    pass\n"),
    "log_secrets": ("log.debug('got %s', api_key)\n", [(1, "HIGH")], "log.debug('got %s', name)\n"),
    "tls_verify": ("get(url, verify=False)\n", [(1, "CRITICAL")], "get(url, verify=bundle)\n"),
    "zipslip": ("archive.extractall(folder)\n", [(1, "HIGH")], "archive.extractall(folder.resolve())\narchive.extract(name)\n"),
    "hardcoded_tokens": ("api_key = 'A1b2C3d4E5f6G7h8I9'\n", [(1, "CRITICAL")], "api_key = 'short'\napi_key = load('A1b2C3d4E5f6G7h8I9')\n"),
    "weak_crypto": ("cipher = AES.new(key, AES.MODE_ECB)\n", [(1, "HIGH")], "cipher = AES.new(key, AES.MODE_GCM)\n"),
    "trojan_source": ("level = 'user\u202e'\n", [(1, "CRITICAL")], "level = 'usér\u200b'\n"),
    "request_timeout": ("requests.post(url, data)\n", [(1, "HIGH")], "requests.post(url, data, timeout=5)\n"),
    "torch_load": ("net = torch.load(path)\n", [(1, "CRITICAL")], "net = torch.load(path, weights_only=True)\n"),
    "ssh_host_key": ("client.set_missing_host_key_policy(paramiko.AutoAddPolicy())\n", [(1, "HIGH")], "client.set_missing_host_key_policy(paramiko.RejectPolicy())\n"),
    "except_pass": ("try:\n    go()\nexcept KeyError:\n    pass\n", [(3, "MEDIUM")], "try:\n    go()\nexcept KeyError:\n    x = 0\n"),
    "pandas_eval": ("pd.eval(text)\n", [(1, "CRITICAL")], "pd.concat(parts)\n"),
    "numpy_load": ("np.load(path, allow_pickle=True)\n", [(1, "HIGH")], "np.load(path)\n"),
    "pandas_pickle": ("frame = pd.read_pickle(path)\n", [(1, "CRITICAL")], "frame = pd.read_parquet(path)\n"),
    "numpy_load_lib": ("numpy.ctypeslib.load_library('fast.so', '.')\n", [(1, "HIGH")], "numpy.load('fast.npy')\n"),
    "pandas_xml_xxe": ("pd.read_xml(path)\n", [(1, "HIGH")], "pd.read_xml(path, parser='etree')\n"),
    "pth_startup_hooks": ("site.addsitedir(folder)\n", [(1, "HIGH")], "site.getsitepackages()\n"),
    "parquet_arrow_deserialize": ("class T:\n    def __arrow_ext_deserialize__(cls, a, b):\n        return cls()\n", [(2, "CRITICAL")], "class T:\n    def __arrow_ext_serialize__(self):\n        return b''\n"),
    "model_file_load": ("net = joblib.load('net.pkl')\n", [(1, "HIGH")], "net = joblib.load(path)\n"),
    "decode_exec_chains": ("code = base64.b64decode(blob)\nx = 1\nexec(code)\n", [(3, "CRITICAL")], "code = base64.b64decode(blob)\n" + "x = 1\n" * 6 + "exec(code)\n"),
    "bind_all_interfaces": ("server.bind(('0.0.0.0', 80))\n", [(1, "MEDIUM")], "server.bind(('127.0.0.1', 80))\n"),
    "weak_tls_version": ("ctx = ssl.SSLContext(ssl.PROTOCOL_SSLv3)\n", [(1, "HIGH")], "ctx = ssl.SSLContext(ssl.PROTOCOL_TLS_CLIENT)\n"),
    "legacy_pycrypto": ("from Crypto.Cipher import AES\n", [(1, "MEDIUM")], "from cryptography.hazmat import backends\n"),
    "huggingface_unsafe_download": ("M.from_pretrained('org/model')\n", [(1, "MEDIUM")], "M.from_pretrained('org/model', revision='abc123')\n"),
    "unbounded_pydantic_field": ("class NoteInput(BaseModel):\n    text: str\n", [(2, "MEDIUM")], "class NoteInput(BaseModel):\n    text: str = Field(max_length=80)\n"),
    "dependency_cve": ("requests==2.30.0\n", [(1, "HIGH")], "requests==2.32.4\n"),
    "unbounded_pins": ("'flask>=2.0'\n", [(1, "LOW")], "'flask>=2.0,<3'\n'flask==2.0'\n"),
}
NAMES = {"dependency_cve": "requirements.txt", "unbounded_pins": "pyproject.toml"}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{rule}/{kind}/{NAMES.get(rule, 'm.py')}", text) for rule, (bad, _, good) in PAIRS.items() for kind, text in (("bad", bad), ("good", good))]
    frame = spark.createDataFrame(rows, "path string, text string")
    return [tuple(r) for r in scan.scan_frame(frame).select("path", "ordinal", "line", "severity").collect()]


def test_all_rules_have_a_pair():
    assert PAIRS.keys() == set(scan.REGISTRY)


@pytest.mark.parametrize("rule", sorted(PAIRS))
def test_pair(found, rule):
    ordinal = ({r.name: r.ordinal for r in (*TEXT_RULES, *TREE_RULES)} | scan.MANIFEST_RULES)[rule]
    name = NAMES.get(rule, "m.py")
    assert sorted((n, s) for p, o, n, s in found if p == f"{rule}/bad/{name}" and o == ordinal) == PAIRS[rule][1]
    assert not [p for p, o, _, _ in found if p == f"{rule}/good/{name}" and o == ordinal]
