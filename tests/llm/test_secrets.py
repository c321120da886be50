import hashlib
import random
import re

import pytest

from siftline.llm.secrets import RULES, Rule, digest, mask_secrets, scan_secrets, trigram_query

from .conftest import sentence

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [s for _, _, s in sorted(out)]


def fake(kind, rng):
    word = lambda n, letters="abcdefghijkLMNOPQ0123456789": "".join(rng.choice(letters) for _ in range(n))
    return {
        "assign": lambda: rng.choice(["password", "Passwd", "SECRET", "token", "apikey", "Api_Key"]) + rng.choice([" = ", ":", '": "', "'='"]) + word(rng.randint(3, 12)),
        "access": lambda: "AKIA" + word(rng.choice([12, 16, 20]), "ABC123"),
        "hex": lambda: word(rng.choice([20, 24, 40]), "0123456789abcdef"),
        "github": lambda: "gh" + rng.choice("pousr") + "_" + word(36),
        "slack": lambda: "xoxb-" + word(14),
        "pem": lambda: "-----BEGIN RSA PRIVATE KEY-----",
        "login": lambda: "https://me:" + word(8) + "@host.example",
    }[kind]()


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    kinds = ["assign", "access", "hex", "github", "slack", "pem", "login"]
    rows = []
    for i in range(150):
        parts = [sentence(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 4)):
            parts += [fake(rng.choice(kinds), rng), sentence(rng, rng.randint(0, 6))]
        rows.append((1000 + i, rng.choice([" ", "", "\n"]).join(parts)))
    return rows + [(900, "token=token: abcdefgh"), (901, "token=" * 3 + "x"), (902, "é𝒜 password='abcdefg' é"), (903, "to\u212aen=abcdefgh \u017fecret=abcdefgh"), (904, "toKEN = abcdef")]


def test_spans_equal_plain_scan(make_docs, planted, odd_rows):
    rows = planted + odd_rows
    scanned = digest(scan_secrets(make_docs(rows))).collect()
    assert len(scanned) == len(rows)
    got = {r.doc_id: r for r in scanned}
    for doc_id, text, *_ in rows:
        expected, r = base_spans(text or ""), got[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest(), (doc_id, text[:80], r.spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in expected) for k in ("assign", "access", "hex"))
        everything = [(m.start(), k, f"{rule.kind}:{m.start()}:{m.end()}") for k, rule in enumerate(RULES) for m in re.finditer(rule.pattern, text or "", re.ASCII) if len(m[rule.group]) >= rule.least]
        assert r.spans == ",".join(s for _, _, s in sorted(everything))


def test_masking_keeps_the_rest(make_docs, planted):
    docs = make_docs([*planted, (950, None), (951, "nothing here")])
    got = {r.doc_id: r for r in mask_secrets(docs).collect()}
    assert mask_secrets(docs).columns == docs.columns and len(got) == len(planted) + 2
    assert got[950].text is None and got[951].text == "nothing here" and got[951].n_chars == 12
    assert got[902].text == "é𝒜 <assign>' é" and got[902].n_chars == len(got[902].text)
    assert all(not base_spans(got[i].text) for i, _ in planted)


def test_many_matches_in_one_text(make_docs):
    text = " é".join(f"token=abcdef{i:06d}" for i in range(20_000))
    docs = make_docs([(1, text)])
    r = digest(scan_secrets(docs)).first()
    assert r.n_assign == 20_000 and r.spans == ",".join(f"assign:{m.start()}:{m.end()}" for m in ASSIGN.finditer(text))
    assert mask_secrets(docs).first().text == " é".join(["<assign>"] * 20_000)


def test_keys_and_logins_are_masked_whole(make_docs):
    body = "\n".join(["MIIEpAIBAAKCAQEA7bq3" + "x" * 44] * 9)
    key = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES,00\n\n{body}\n-----END RSA PRIVATE KEY-----"
    rows = [(1, f"a {key} b"), (2, f"a -----BEGIN PRIVATE KEY-----\n{body}== and prose"), (3, f"redis://:{'p' * 80}@host"), (4, "-----BEGIN PRIVATE KEY----- only said")]
    got = {r.doc_id: r.text for r in mask_secrets(make_docs(rows)).collect()}
    assert got == {1: "a <pem> b", 2: "a <pem> and prose", 3: "redis<login>host", 4: "<pem> only said"}


def test_trigram_queries():
    assert trigram_query("[0-9a-f]{24,}") is None and trigram_query("ab|c") is None
    assert trigram_query("(?:abc|abcd)x?") == [frozenset({"abc"})]
    assert trigram_query("abc.*xyz") == [frozenset({"abc", "xyz"})]
    assert trigram_query(r"a\.b\x20c{2}d") == [frozenset({"a.b", ".b ", "b c", " cc", "ccd"})]
    assert trigram_query(r"[^a]bcd|[]x]yzz+") is None and trigram_query(r"x(?:abc|ab\d+)y") is None
    assert trigram_query("[a-c]ok") == [frozenset({"aok"}), frozenset({"bok"}), frozenset({"cok"})]
    with pytest.raises(ValueError):
        trigram_query("a(?=b)")
    rng = random.Random(1)
    for pattern, made in ((r"gh[pousr]_[a-z]{3}", lambda: f"gh{rng.choice('pousr')}_abc"), (r"(?i:api_?key)=", lambda: rng.choice(["APIkey=", "api_KEY="]))):
        for _ in range(20):
            text = made().lower()
            assert any(all(g in text for g in s) for s in trigram_query(pattern))


def test_empty_table_and_own_rules(make_docs):
    docs = make_docs([(1, "zz")])
    assert digest(scan_secrets(docs.limit(0))).count() == 0
    found = scan_secrets(docs, (Rule("z", "z"),)).first().found
    assert [(s.start, s.stop) for s in found] == [(0, 1), (1, 2)]
