import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import secrets

KEYS = ["password", "passwd", "secret", "token", "api_key", "apikey"]


def plain(text):
    """The contract, letter by letter."""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    found = []
    for kind, pattern, group, least in (("assign", rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)):
        found += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2]), s[1]))


pieces = st.lists(st.one_of(st.sampled_from([*KEYS, "ToKen", "paſſword", "toKen", ":", "=", " ", "'", '"', "AKIA", "AKIAAAAA", "\n", "é😀", "0123456789abcdef", "ABCDEF12", "abcd", "+/=", "${", "}", "<a>", "--x "]), st.text(max_size=4)), max_size=14).map("".join)


@given(pieces)
@settings(max_examples=400, deadline=None)
def test_base_spans_stay(text):
    assert [s for s in secrets.scan(text) if s[2] != "literal"] == plain(text)


def literals(text):
    return [text[a:b] for a, b, k in secrets.scan(text) if k == "literal"]


def test_assignments():
    assert literals("db_password = 'hunter2XYZ!'") == ["hunter2XYZ!"]
    assert literals('{"clientSecret": "q8Zt-77f_aa", "user": "bob"}') == ["q8Zt-77f_aa"]
    assert literals("<password>s3cr3tPass</password>") == ["s3cr3tPass"]
    assert literals("run --auth-token tk_9f8e7d6c5b now") == ["tk_9f8e7d6c5b"]
    assert literals("first = 'ab12CD34'\nsecond = first + 'zz99'\napi_secret = second") == ["ab12CD34", "zz99"]
    assert literals("export BASE=Zx81_kk99\nDB_PASSWORD=${BASE}") == ["Zx81_kk99"]
    assert literals("password = 'changeme'") == []
    assert literals("password_file = '/etc/app/pw_file_1'") == []
    assert literals("The token: it is here. Nothing = secret about the password of this") == []
    assert literals("a = a\nsecret = a") == []


def test_all_white_space_and_lines():
    assert literals('"pwd" : "Zx81_kk99"') == ["Zx81_kk99"]
    assert literals("auth_credential : Zx81_kk99") == ["Zx81_kk99"]
    assert literals("DB_PWD =\tZx81_kk99") == ["Zx81_kk99"]
    assert literals('pwd:\t"Zx81_kk99"') == ["Zx81_kk99"]
    assert literals("pwd: /Zx81_kk99") == ["/Zx81_kk99"]
    assert literals("BASE :\t'Zx81_kk99'\npwd = BASE") == ["Zx81_kk99"]
    assert literals("pwd =\n\n  'Zx81_kk99'\nother = 'plain text'") == ["Zx81_kk99"]
    assert literals("pwd = 'Zx81' +\n  '_kk99'") == ["Zx81", "_kk99"]
    assert literals("run --auth-token \\\n  tk_9f8e7d6c5b") == ["tk_9f8e7d6c5b"]
    assert [x.strip() for x in literals("<cfg>\n<password>\n s3cr3tPass\n</password>\n</cfg>")] == ["s3cr3tPass"]
    assert literals("pwd =") == literals("pwd: {\n  name: 'Zx81_kk99'\n}") == []


def test_long_lines_take_time_in_proportion():
    """A million characters that almost are an element, a reference, an option or a string."""
    for piece in ("x=1 <" + "a" * 10, "${" + "a" * 10, "<a " * 4, "--a" * 4, "<a>b" * 3, "'", '"a', "a.", "a-", "${a{", "password", "token ", "AKIA", "a = "):
        text = "x=" + piece * (1_000_000 // len(piece))
        began = time.perf_counter()
        secrets.scan(text)
        assert time.perf_counter() - began < 60, piece
    for start in ("x=1 <", "x=${", "x=--", "x='"):
        began = time.perf_counter()
        secrets.scan(start + "a" * 1_000_000)
        assert time.perf_counter() - began < 10, start


def test_precision_and_recall_on_planted_secrets():
    """Assignments of random values to sensitive and to harmless names, in ten notations, some by way of a constant."""
    rng = random.Random(12)
    value = lambda: "".join(rng.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=rng.randrange(12, 33)))
    sensitive = ["db_password", "clientSecret", "AUTH_TOKEN", "api_key", "privateKey", "smtp-passwd", "jwt_secret", "userCredentials", "ROOT_PWD", "accessToken"]
    harmless = ["user_name", "build_id", "outputPath", "PAGE_URL", "itemCount", "color", "title", "publicKey", "log_file", "region"]
    forms = ["{n} = '{v}'", '"{n}": "{v}",', "{n}: {v}", "export {n}={v}", "<{n}>{v}</{n}>", "run --{n} {v} now", "{n} := \"{v}\"", "{n}='{v}';", "base = '{v}'\n{n} = base", "BASE={v}\n{n}=${{BASE}}"]
    right = wrong = missed = 0
    for _ in range(2000):
        n, v, bad = (name := rng.choice(sensitive + harmless)), value(), name in sensitive
        found = {x for x in literals("some words\n" + rng.choice(forms).format(n=n, v=v) + "\nmore words here")}
        right += bad and found == {v}
        missed += bad and v not in found
        wrong += len(found - {v}) + (not bad and v in found)
    print(f"precision {right / (right + wrong):.3f}, recall {right / (right + missed):.3f}")
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_constants_keep_all_literals():
    many = " + ".join(f"'k{i}Z'" for i in range(200))
    assert len(literals(f"whole = {many}\npwd = whole")) == 200
    doubled = "c0 = 'aB3'\n" + "".join(f"c{i + 1} = c{i} + c{i}\n" for i in range(2000))
    assert literals(doubled + "pwd = c2000 + 'zz99'") == ["aB3", "zz99"]


@given(st.lists(st.sampled_from(["x", "X", " ", "ab", "\t", "", "todo", "<", ">", "y" * 70, "x" * 70, "é 1"]), max_size=6))
@settings(max_examples=300, deadline=None)
def test_values_score_like_their_text(pieces):
    graph, whole = secrets.Value(), "".join(pieces)
    for piece in pieces:
        graph.add(secrets.Value(piece))
    refused = len(whole) < 6 or bool(secrets.PLACEHOLDER.match(whole)) or " " in whole.strip()
    assert (secrets.value_score(graph) == -1.0) == refused
    assert secrets.value_score(graph) == secrets.value_score(secrets.Value(whole))


def test_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "token = 'abcdefgh1'", "x"), (3, "word " * 50_000 + "password=b7db7aa4a5fcc78305", "y"), (3, "password: secret: abcdefgh12", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = secrets.find_secrets(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len([s for s in r.spans if s.kind != "literal"])) for r in found) == [(False, 1, 0), (False, 2, 0), (False, 3, 0), (False, 3, 1), (True, 0, 1)]
    assert secrets.find_secrets(df.limit(0)).count() == 0
