"""Secret scan against plain forms of the rules."""

import hashlib
import random
import re
import string
from collections import Counter
from math import log2

import pytest

from tests.llm.conftest import EDGE, frame
from turnwise.llm import secret_scan as S


def base(text):
    """The known forms as stated: every match of the open pattern, then the length test."""
    letter = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join([letter(w) for w in ("password", "passwd", "secret", "token")] + [letter("api") + "_?" + letter("key")])
    out = []
    for m in re.finditer("(" + names + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def slow_windows(text, size, bits):
    marked = [False] * len(text)
    for i in range(len(text) - size + 1):
        c = Counter(text[i:i + size])
        if -sum(k / size * log2(k / size) for k in c.values()) >= bits - 1e-9:
            marked[i:i + size] = [True] * size
    return marked


def test_windows_by_full_counts():
    rng = random.Random(5)
    for n in (0, 3, 19, 20, 21, 60, 200):
        for letters in ("ab", "0123456789abcdef", string.ascii_letters + string.digits):
            for bits in (1.0, 3.0, 3.5):
                text = "".join(rng.choice(letters) for _ in range(n)) + "aaaa" * (n % 3)
                marked = [False] * len(text)
                for a, b in S.windows(text, 20, bits):
                    marked[a:b] = [True] * (b - a)
                assert marked == slow_windows(text, 20, bits)


ODD = ["", "password=abc", "password=token:abcdefg", "PassWord : 'hunter22", "apikey=======", "API_KEY=\"a.b-c_d\"", "Key toKen=abcdefgh", "ſecret=abcdefgh",
       "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 11, "AKIA" + "B" * 15, "xAKIA" + "C" * 30 + "x", "deadbeef" * 3, "deadbeef" * 2 + "deadbee", "g" + "0123456789abcdef" * 4 + "G",
       "secret" + " " * 5000 + "= abcdefgh", "secret= ' abcdefgh", "\U0001f600 token=éabcdef token=abcdefé", "passwordpassword=abcdef", "token=" + "x" * 100_000,
       "token \n= abcdefgh", "my_secret_token = 'AKIA" + "Z9" * 10 + "'", "feed" * 500]


def test_known_forms():
    for text in ODD:
        assert [s for s in S.spans_of(text) if s[0] in ("assign", "access", "hex")] == base(text), text
    rng = random.Random(11)
    bits = ["password", "Token", "api_key", "apikey", "secret", "=", ":", " ", "'", '"', "AKIA", "A1B2C3D4E5F6", "0a1b2c3d4e5f", "é", "zz", "passwd", "-", "f" * 12]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert [s for s in S.spans_of(text) if s[0] in ("assign", "access", "hex")] == base(text), text


@pytest.mark.parametrize("text", [
    "Donaudampfschifffahrtsgesellschaftskapitaen and pneumonoultramicroscopicsilicovolcanoconiosis", "4041894974608795 4279055890764913 12345678901234567890123",
    "see https://example.org/a/Zx81kQpLw0vTn5RbYc3dEf7gHj2s?x=Zx81kQpLw0vTn5RbYc3d", "id 123e4567-e89b-42d3-a456-426614174000 of it", "aaaaaaaaaaaaaaaaaaaaaaaa1111111111",
    "path/to/some/file_name_2020/and_more", "key AbCdEfGhIjKlMnExample0123456789", "sha256: Zx81kQpLw0vTn5RbYc3dEf7gHj2s9Aq", "2020-01-02T03:04:05-2021-01-02"])
def test_what_is_no_secret(text):
    assert [s for s in S.spans_of(text) if s[0].startswith("entropy")] == []


def test_random_strings_are_found():
    rng = random.Random(3)
    seen = Counter()
    for _ in range(300):
        for name, letters, n in (("hex", "0123456789ABCDEF", 32), ("alnum", string.ascii_lowercase + string.digits, 32), ("base64", string.ascii_letters + string.digits + "+/", 40)):
            value = "".join(rng.choice(letters) for _ in range(n))
            spans = [s for s in S.spans_of(f"use the value {value} here") if s[0].startswith("entropy")]
            seen[name] += any(a < 14 + n and b > 14 for _, a, b in spans)
    assert min(seen.values()) >= 290


def test_tables(spark, docs, edge, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert_equal(spark, docs, rows)
    odd = EDGE + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "token=abcdefgh"), (None, "token=abcdefgh")]
    assert_equal(spark, frame(spark, odd), odd)
    assert S.digests(S.scan(none)).collect() == []


def assert_equal(spark, table, rows):
    def listed(spans):
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = []
    for i, text in rows:
        known = base(text or "")
        n = Counter(k for k, _, _ in known)
        want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(listed(known).encode()).hexdigest(), listed(S.spans_of(text or ""))))
    got = [tuple(r) for r in S.digests(S.scan(table)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()]
    assert Counter(got) == Counter(want)
