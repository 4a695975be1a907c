import base64
import bz2
import contextlib
import gzip
import hashlib
import random
import re
import time
import urllib.parse
import zlib

import corpus
import pytest

from barline.llm import secrets as op

KEY = "AKIA" + "ABCD1234EFGH5678"
SECRET = "password = hunter2hunter2"


def plain(text):
    """The base rules, written out."""
    text, out = text or "", []
    rule = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(rule, text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_base_rules():
    rnd = random.Random(1)
    pieces = ["token", "secret", "=", ":", " ", '"', "'", "AKIA", "A1", "f00d", "abcdef0123456789", "API_KEY", "Apikey", "x", "é", "ſecret", "toKen", "\n", "/+", "Z"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25)))
        assert op.scan(text)[0] == plain(text), text


def b64(x):
    return base64.b64encode(x.encode() if isinstance(x, str) else x).decode()


WRAP = {
    "url": lambda t: urllib.parse.quote(t, safe=""),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "base64": b64,
    "urlsafe": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
    "gzip": lambda t: b64(gzip.compress(t.encode())),
    "zlib": lambda t: b64(zlib.compress(t.encode())),
}


@pytest.mark.parametrize("one", WRAP)
@pytest.mark.parametrize("two", [None, *WRAP])
def test_nested_layers_are_found_in_place(one, two):
    inner = WRAP[one](f"some text {KEY} and more")
    hidden = WRAP[two](inner) if two else inner
    text = f"Ünïcode prose \U0001f600 before, {hidden} after."
    base, spans = op.scan(text)
    assert set(base) <= set(spans)
    found = [(s, e) for s, k, e in spans if k == 1]
    begin = text.index(hidden)
    assert found and all(begin <= s < e <= begin + len(hidden) for s, e in found)


def test_exact_span_through_escapes():
    text = "see x=%41KIAABCD1234EFGH5678%20end"
    base, spans = op.scan(text)
    assert base == []
    assert spans == [(6, 1, 6 + len("%41KIAABCD1234EFGH5678"))]
    text = r"q password=hunter2hunter2 r"
    assert [text[s:e] for s, _, e in op.scan(text)[1]] == [r"password=hunter2hunter2"]


def kinds(text):
    base, spans = op.scan(text)
    return [(k, text[s:e]) for s, k, e in spans if (s, k, e) not in base]


def test_escapes_are_decoded_in_place():
    assert kinds("a password%3D hunter2hunter2 b") == [(0, "password%3D hunter2hunter2")]
    assert kinds(r"{\u0022password\u0022: \u0022hunter2hunter2\u0022}") == [(0, r"password\u0022: \u0022hunter2hunter2")]
    assert kinds("password%3Dhunter2hunter2&x=%E9") == [(0, "password%3Dhunter2hunter2")]
    assert kinds(r"\ud800 x=\u0041KIAABCD1234EFGH5678 \x41") == [(1, r"\u0041KIAABCD1234EFGH5678")]
    assert kinds("é%25 password%253D hunter2hunter2 %41") == [(0, "password%253D hunter2hunter2")]


def test_base64_with_other_bytes_lines_and_offsets():
    for data in (b"\0\x01" + SECRET.encode() + b"\xff end", b"\xe9 " + KEY.encode() + b" \0\0"):
        assert len(kinds(f"see {b64(data)} end")) == 1
    text = "x" * 50 + " " + KEY + " " + "some more text here " * 4
    for end in ("\n", "\r\n", "\n  "):
        for n in (60, 64, 76):
            code = end.join(b64(text)[i : i + n] for i in range(0, len(b64(text)), n))
            assert [k for k, _ in kinds(f"body:\n{code}\n\nend")] == [1], (end, n)
            packed = b64(gzip.compress(random.Random(4).randbytes(300) + text.encode()))
            code = end.join(packed[i : i + n] for i in range(0, len(packed), n))
            assert [k for k, _ in kinds(f"body:\n{code}\n\nend")] == [1], (end, n)
    for prefix in ("a/", "id/", "key/", "path/", "v1/x/"):
        assert [k for k, _ in kinds(f"see {prefix}{b64(text)} end")] == [1]
        assert [k for k, _ in kinds(f"see {prefix}{b64(gzip.compress(text.encode()))} end")] == [1]


def test_compressed_data_is_read_to_its_end(monkeypatch):
    monkeypatch.setattr(op, "MAX_UNPACKED", 1 << 12)
    monkeypatch.setattr(op, "OVERLAP", 1 << 8)
    for n in (0, 4000, 4080, 4090, 9000, 50_000):
        for pack in (gzip.compress, zlib.compress):
            assert [k for k, _ in kinds(b64(pack(b"\0" * n + KEY.encode() + b" ")))] == [1]
    assert [k for k, _ in kinds(b64(gzip.compress(b"first ") + gzip.compress(KEY.encode())))] == [1]
    assert [k for k, _ in kinds(b64(gzip.compress(KEY.encode() + b" " + random.Random(3).randbytes(3000))[:-900]))] == [1]


def test_deep_nesting_and_bombs_end():
    text = KEY + " " + "x" * 30
    for _ in range(12):
        text = b64(text)
    assert [(0, 1, len(text))] == op.scan(text)[1]
    bomb = b64(zlib.compress(b"\0" * (op.MAX_UNPACKED + 10)))
    assert op.scan(bomb) == (plain(bomb), plain(bomb))
    assert op.scan("%25" * 500)[0] == []


def test_prose_and_damaged_codes_give_nothing():
    for text in ("%zz %4 \\u12 \\x", "ordinarywordwithoutanything another", "%ff%fe" * 10, "\\ud800 alone", "A" * 1000):
        assert op.scan(text) == ([], [])


def test_columns(spark, dirty, empty):
    rows = [(1, f"a {SECRET} b", None, None), (2, f"x {b64(KEY + ' in here')} y", None, None), (3, "0123456789abcdef " * 3, None, None)]
    got = {r["doc_id"]: r for r in op.digest_columns(op.secret_spans(corpus.rows_to_docs(spark, rows))).collect()}
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (1, 0, 0)
    assert got[1]["spans"] == f"assign:2:{2 + len(SECRET)}"
    assert got[1]["base_sha256"] == hashlib.sha256(got[1]["spans"].encode()).hexdigest()
    assert got[2]["n_access"] == 0 and got[2]["spans"].startswith("access:2:")
    assert got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3]["n_hex"] == 3
    found = op.digest_columns(op.secret_spans(dirty))
    assert sorted((r["doc_id"] for r in found.collect()), key=repr) == sorted((r[0] for r in corpus.dirty_rows()), key=repr)
    assert op.secret_spans(empty).count() == 0


def raw_deflate(data):
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


def spans_of(text):
    return {(op.KINDS[k], text[s:e]) for s, k, e in op.scan(text)[1]}


PLAIN = "password=hunter2hunter2"


@pytest.mark.parametrize("chain", ["%" + "25" * 300_000 + "41", "\\" + "u005c" * 100_000 + "u0041", "\\" + "x5C" * 100_000 + "x41"])
def test_a_long_chain_of_escaped_escapes_takes_one_pass(chain):
    begin = time.time()
    base, found = op.scan(chain + " password%" + "25" * 50 + "3Dhunter2hunter2")
    assert time.time() - begin < 10 and len(found) - len(base) <= 4
    assert any(k == 0 for _, k, _ in found)


def wrapped(data):
    return "x " + base64.b64encode(data).decode() + " y"


@pytest.mark.parametrize("text", [
    wrapped(PLAIN.encode("utf-16-le")), wrapped(PLAIN.encode("utf-16")), wrapped(b"?" + PLAIN.encode("utf-16-be")),
    wrapped(bz2.compress(PLAIN.encode())), wrapped(b"junk" + bz2.compress(PLAIN.encode() * 50)),
    wrapped(raw_deflate(PLAIN.encode() + b" and so on" * 9)),
    "password%u003Dhunter2hunter2", "password\\u{3d}hunter2hunter2", "password%25u003dhunter2hunter2", "password\\u005cu{00003D}hunter2hunter2",
])
def test_more_layers(text):
    assert any(kind == "assign" for kind, _ in spans_of(text)), text


def test_odd_escapes_stay():
    for text in ("%u", "%uD800", "\\u{}", "\\u{FFFFFF}", "%25", "%2", "\\u005", wrapped(bz2.compress(b"z" * 50)[:-9]), wrapped(b"BZh91AY&SY" + b"q" * 40)):
        assert op.scan(text)[1] == op.scan(text)[0]


def decoded(text):
    """A plain decoder: all layers of URL, backslash and base64 codes of whole words, without spans."""
    seen, todo = set(), [text]
    while todo:
        t = todo.pop()
        if t in seen:
            continue
        seen.add(t)
        todo.append(re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 128 else m[0], t))
        todo.append(re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 0xD800 else m[0], t))
        for word in re.findall(r"[A-Za-z0-9+/]{16,}={0,2}", t):
            with contextlib.suppress(ValueError):
                todo.append(base64.b64decode(word).decode("ascii"))
    return seen


@pytest.mark.parametrize("seed", range(30))
def test_against_a_plain_decoder(seed):
    rnd = random.Random(seed)
    text = f"{rnd.choice(['api_key: ', 'token='])}{rnd.getrandbits(80):020x}zz"
    for _ in range(rnd.randint(1, 4)):
        text = {
            "url": lambda t: "".join(f"%{ord(c):02X}" if not c.isalnum() or rnd.random() < 0.1 else c for c in t),
            "unicode": lambda t: "".join(f"\\u{ord(c):04x}" if rnd.random() < 0.2 else c for c in t),
            "base64": lambda t: base64.b64encode(t.encode()).decode(),
        }[rnd.choice(["url", "unicode", "base64"])](text)
    text = "see " + text + " there."
    want = any(op.ASSIGN.search(t) and len(op.ASSIGN.search(t)[2]) >= 12 for t in decoded(text))
    assert want == any(kind == "assign" for kind, _ in spans_of(text))
