"""Decontamination, secrets, licences, packing and token files on small and odd tables."""

import base64
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmine.llm import decontaminate, licenses, packing, secrets, simple8b, tokens

ODD = [(1, "", "a"), (2, None, "a"), (3, "  two  spaces \n\n x\t", None), (None, "no id here", "b"), (5, "same text", "b"), (5, "same text", "b"), (6, "é ñ 東京 \U0001f600 don't!!", "c"), (7, "word " * 6000, "a")]
SCHEMA = "doc_id long, text string, source string, part long, n long, id long, queue string"


@pytest.fixture(scope="module")
def docs(spark):
    """Also with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, s, 9, 9, 9, "q") for d, t, s in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def encoder():
    return tokens.PieceEncoder(tokens.vocabulary())


def ids_of(encoder, text):
    return encoder.tok.encode(text or "", add_special_tokens=False).ids


# --- token ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\t\r\x1c\x85  ab1!'.,séĊĠ東<|>")), max_size=40), max_size=5))
def test_pieces_give_the_librarys_ids(encoder, texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [ids_of(encoder, t) for t in texts]


def test_pieces_after_the_memory_was_emptied():
    e = tokens.PieceEncoder(tokens.vocabulary(), most=3)
    texts = ["one two three, four five. six\nseven eight", "one two nine ten"]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == [ids_of(e, t) for t in texts]


def test_other_tokenizers_encode_whole_texts():
    e = tokens.PieceEncoder(tokens.vocabulary("word_bpe_49k.json"))
    assert not e.by_piece
    assert np.frombuffer(e.encode(["Two words"])[0], "<u4").tolist() == ids_of(e, "Two words")


# --- token files


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=2500))
def test_words_round_trip(values):
    a = np.array(values, dtype=np.uint64)
    names, lengths, back = simple8b.read_block(simple8b.write_block([7, None], [len(a) // 2, len(a) - len(a) // 2], a))
    assert names == [7, None] and (back == a).all() and lengths.sum() == len(a)


def test_runs_of_one_kind():
    for v in (0, 1, 2**15, 2**60 - 1, 2**60, 2**64 - 1):
        for n in (1, 119, 120, 121, 1023, 1024, 1025, 3000):
            a = np.full(n, v, dtype=np.uint64)
            words, offsets, escapes = simple8b.encode_words(a)
            assert (simple8b.decode_words(words, n, offsets, escapes) == a).all()
    assert len(simple8b.encode_words(np.zeros(1024, np.uint64))[0]) == 9


def test_token_files(spark, docs, encoder):
    out = simple8b.read_ids(simple8b.write_ids(docs)).collect()
    assert len(out) == len(ODD)
    want = sorted(((d, np.array(ids_of(encoder, t) + [0], "<u4").tobytes()) for d, t, _ in ODD), key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    for (d, raw), r in zip(want, sorted(out, key=lambda r: r["start"])):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (d, at, len(raw) // 4, zlib.crc32(raw), raw)
        at += len(raw) // 4
    empty = simple8b.read_ids(simple8b.write_ids(docs.limit(0)))
    assert empty.count() == 0


# --- packing


def check_pieces(pieces, encoder, rows, length):
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append(np.array(ids_of(encoder, t) + [1], "<u4"))
    by, where = {}, {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
        where.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, of in by.items():
        assert sum(r["length"] for r in of) == sum(map(len, texts[d]))
        for r in of:
            assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(x) for x in texts[d])
    assert set(by) == set(texts)
    short = 0
    for spans in where.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= length
        short += at < length
    assert short <= 1 and sorted(where) == list(range(len(where)))


@pytest.mark.parametrize("targets", [None, {"a": 1, "b": 3}, {"zzz": 1.0}, {"a": 0.5, "b": 0.25, "*": 0.25}, {None: 1.0, "a": 1.0}])
def test_packing(spark, docs, encoder, targets):
    pieces = packing.pack(docs, targets, length=64, window=256).collect()
    check_pieces(pieces, encoder, ODD, 64)


def test_packing_keeps_the_mixture_in_every_window(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["red", "blue", "green"]) for _ in range(rng.randint(1, 400))), rng.choice("xxxy")) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for targets in (None, {"x": 1, "y": 1}):
        pieces = packing.pack(df, targets, length=128, window=1024).collect()
        total = sum(r["length"] for r in pieces)
        share = sum(r["length"] for r in pieces if r["source"] == "y") / total if targets is None else 0.5
        per = {}
        for r in pieces:
            w = (r["sequence_id"] * 128 + r["offset"]) // 1024
            per.setdefault(w, [0, 0])[r["source"] == "y"] += r["length"]
        until = len(per) - 1 if targets is None else sum(r["length"] for r in pieces if r["source"] == "y") * 2 // 1024
        for w in range(until):
            assert abs(per[w][1] / sum(per[w]) - share) < 0.02


def test_sequences(spark, docs):
    rows = {r["sequence_id"]: r for r in packing.sequences(packing.pack(docs, length=64), 64).collect()}
    for r in rows.values():
        n = r["n_tokens"]
        assert len(r["ids"]) == 4 * r["padded"] and (r["padded"] == 64 or n & (n - 1) == 0)
    assert packing.pack(docs.limit(0)).count() == 0


# --- secrets


def plain_spans(text):
    text = text or ""
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    a = [("assign", m.start(), m.end()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    a += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(a + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24], key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "ToKeN", "api_key", "apikey", "seſret", "secret", " ", ":", "=", '"', "'", "abc", "abcdef", "0123456789abcdef0123456789", "AKIA", "ABCDEFGH12345678", "\n", "é", "/", "."]), max_size=25).map("".join))
def test_plain_spans_stay(text):
    assert [s[:3] for s in secrets.spans(text) if s[0] in ("assign", "access", "hex")] == plain_spans(text)


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def keys():
    """Private keys in all encodings, and things that parse but aren't."""
    rng = random.Random(0)
    raw = lambda n: bytes([1] + [rng.randrange(256) for _ in range(n)])
    number = lambda n: der(2, raw(n))
    zero, one, rsa, ec = der(2, b"\0"), der(2, b"\1"), der(6, bytes.fromhex("2a864886f70d010101")), der(6, bytes.fromhex("2a8648ce3d0201"))
    pkcs1 = der(0x30, zero + b"".join(number(n) for n in (128, 2, 120, 60, 60, 60, 60, 60)))
    sec1 = der(0x30, one + der(4, raw(31)) + der(0xA0, ec) + der(0xA1, der(3, raw(64))))
    pbe = der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")) + der(0x30, der(4, raw(8))))
    part = lambda b: len(b).to_bytes(4, "big") + b
    good = {
        "pkcs1": pkcs1, "dsa": der(0x30, zero + b"".join(number(n) for n in (64, 20, 64, 64, 20))), "sec1": sec1,
        "pkcs8": der(0x30, zero + der(0x30, rsa + der(5, b"")) + der(4, pkcs1)), "ed25519": der(0x30, zero + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, raw(31)))),
        "encrypted": der(0x30, pbe + der(4, raw(95))),
    }
    container = b"openssh-key-v1\0" + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(raw(50)) + part(raw(127))
    bad = {
        "public": der(0x30, der(0x30, rsa + der(5, b"")) + der(3, raw(130))), "rsa public": der(0x30, number(128) + number(2)), "digest": der(0x30, der(0x30, rsa + der(5, b"")) + der(4, raw(31))),
        "certificate": der(0x30, der(0x30, der(0xA0, der(2, b"\2")) + number(8) + der(0x30, rsa)) + der(0x30, rsa) + der(3, raw(128))), "short": pkcs1[:-1], "noise": raw(90),
    }
    return good, container, bad


def test_confirmation():
    good, container, bad = keys()
    b64 = lambda x: base64.b64encode(x).decode()
    kinds = lambda t: [s[0] for s in secrets.spans(t)]
    held = lambda t: [t[s[1] : s[2]] for s in secrets.spans(t) if s[0] not in ("assign", "access", "hex")]
    for name, key in good.items():
        assert held(f"x {b64(key)} y") == [b64(key)], name
        assert held(f"x {key.hex()} y") == [key.hex()] and held(f"x {key.hex().upper()} y") == [key.hex().upper()]
        mixed = "".join(c.upper() if i % 3 else c for i, c in enumerate(key.hex()))
        assert held(f"x {mixed} y") == [mixed] and held(f"0{key.hex()}") == [key.hex()]
        assert b64(key).rstrip("=") in held(f"/etc/keys/{b64(key)}")[0] and b64(key).rstrip("=") in held(f"n{b64(key)} y")[0]
        for sep in ("\n", "\r\n", "\\n", "\\r\\n"):
            pem = f"-----BEGIN PRIVATE KEY-----{sep}{sep.join(b64(key)[i : i + 64] for i in range(0, len(b64(key)), 64))}{sep}-----END PRIVATE KEY-----"
            assert pem in held(f'"key": "{pem}"'), (name, sep)
    for name, raw in bad.items():
        assert held(f"x {b64(raw)} y") == [] and held(f"x {raw.hex()} y") == [], name
        for label in ("CERTIFICATE", "PUBLIC KEY", "PRIVATE KEY"):
            assert held(f"-----BEGIN {label}-----\n{b64(raw)}\n-----END {label}-----") == [], name
    sealed = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{b64(bytes(range(64)))}\n-----END RSA PRIVATE KEY-----"
    assert held(sealed) == [sealed] and held(sealed.replace("Proc-Type: 4,ENCRYPTED\n", "")) == []
    assert kinds(f"-----BEGIN OPENSSH PRIVATE KEY-----\n{b64(container)}\n-----END OPENSSH PRIVATE KEY-----")[0] == "pem" and kinds(b64(container)) == ["ssh"]
    assert kinds(b64(container[:40] + container[44:])) == [] and kinds(b64(b"openssh-key-v1\0" + bytes(60))) == []
    blob = b"".join(len(p).to_bytes(4, "big") + p for p in (b"ssh-ed25519", bytes(range(32))))
    assert kinds("ssh-ed25519 " + b64(blob)) == []  # public
    part = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'x'})}.c2lnbmF0dXJl"
    assert kinds(f"see {token}.") == ["jwt"] and kinds(f"{part({'no': 'alg here'})}.{part({'sub': 'x'})}.abc") == []
    text = f'token = "abcdef123456" and {token}'
    assert secrets.redact(text, secrets.spans(text)) == 'token = "[SECRET]" and [SECRET]'


def test_secret_scan(spark, docs):
    got = secrets.find_secrets(docs, keep=("doc_id", "id"), with_text=True).collect()
    assert len(got) == len(ODD) and all(r["spans"] == [] for r in got)
    assert sorted((r["redacted"] is None) for r in got).count(True) == 1
    assert secrets.find_secrets(docs.limit(0)).count() == 0
    clash = docs.select("doc_id", "text", F.lit(1).alias("spans"), F.lit(2).alias("Redacted"), F.lit(3).alias("_text"), F.lit(4).alias("a.b"))
    got = secrets.find_secrets(clash, keep=tuple(clash.columns), with_text=True)
    assert got.columns == ["doc_id", "text", "spans", "Redacted", "_text", "a.b", "_spans", "_redacted"] and got.where("spans = 1 and _redacted is null").count() == 1


# --- decontamination


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=14), st.text("abc", max_size=30))
def test_myers(p, t):
    assert decontaminate.myers(p, t, len(p))[0] == (distance(p, t) if t else len(p) + 1)


def whole_word_distance(p, t):
    """Least edit distance to a run of whole words, with the place."""
    best, p = None, np.array(list(p))
    starts = [i for i in range(len(t)) if t[i] != " " and (not i or t[i - 1] == " ")]
    for a in starts:
        row = np.arange(len(p) + 1)
        for j, c in enumerate(t[a:], a + 1):
            new = np.minimum(row[1:] + 1, row[:-1] + (p != c))
            new = np.concatenate([[j - a], new])
            steps = np.arange(len(p) + 1)
            row = np.minimum.accumulate(new - steps) + steps
            if (j == len(t) or t[j] == " ") and (best is None or (row[-1], a) < best[:2]):
                best = (int(row[-1]), a, j)
    return best


def test_every_passage_within_the_budget_is_found():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abdeiou") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 22))) for _ in range(12)]
    items = decontaminate.Items(list(enumerate(texts)), 0.1)
    for trial in range(60):
        n = rng.randrange(len(texts))
        k, s = items.budget[n], list(texts[n])
        for _ in range(rng.randint(0, k + 2)):
            j = rng.randrange(len(s))
            rng.choice([lambda: s.insert(j, rng.choice("xyz ")), lambda: s.pop(j) if len(s) > 1 else None, lambda: s.__setitem__(j, rng.choice("xyz"))])()
        text = decontaminate.folded(f"{word()} {word()} {''.join(s)} {word()}")
        want = {}
        for i, t in enumerate(texts):
            d = whole_word_distance(t, text) if distance(t, text) <= items.budget[i] else None
            if d and d[0] <= items.budget[i]:
                want[i] = d
        assert {f[0]: f[1:4] for f in items.find(text)} == want, trial


def test_short_items_match_whole_words_only():
    items = decontaminate.Items([(1, "he"), (2, "Cat"), (3, "catenation")], 0.1)
    found = lambda t: sorted(items.ids[f[0]] for f in items.find(decontaminate.folded(t)))
    assert found("the theory") == [] and found("did he?") == [1] and found("concatenate a cat-flap") == [2]
    assert found("concatenation") == [] and found("a catenatian") == [3]


def test_decontamination(spark, docs):
    item = "The quick brown fox jumps over the lazy dog while ten small cats look on."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "...")], "item_id long, text string")
    more = spark.createDataFrame([(50, "x É. " + item.upper().replace("BROWN", "BRAWN") + " end"), (51, "The quick brown fox. Nothing else.")], "doc_id long, text string")
    got = decontaminate.contaminated(docs.select("doc_id", "text").union(more).union(more), bench, chars=5).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == {(50, 1, 1)} and len(got) == 2
    text = more.first()["text"]
    assert text[got[0]["start"] : got[0]["end"]].startswith("THE QUICK") and text[got[0]["start"] : got[0]["end"]].endswith("LOOK ON")
    rows = docs.select("doc_id", "text", F.lit(1).alias("found"), F.lit(2).alias("item_id")).union(more.select("doc_id", "text", F.lit(1), F.lit(2))).union(more.select(F.lit(None), "text", F.lit(1), F.lit(2)))
    clean = decontaminate.uncontaminated(rows, bench, chars=5)
    assert clean.columns == rows.columns and clean.dtypes == rows.dtypes
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted([*(str(d) for d, _, _ in ODD), "51", "None"])
    assert decontaminate.uncontaminated(rows, bench.limit(0)).count() == rows.count()
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


# --- licences


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "a/b/c/x.py", "import os"),
        (3, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "a/y.py", "code\n# Released under the MIT License.\ncode"),
        (5, "z.py", "mit der license to kill"),
        (6, None, "nothing"), (7, "a/q", None), (7, "a/q", None), (None, "a/b/n", ""), (8, "ab/q", "near, but another directory"),
        (9, "a/long.txt", "All rights reserved.\n" + "word " * 5000),
    ]
    df = spark.createDataFrame([(*r, "own", 0.5) for r in rows], "doc_id long, path string, text string, license string, similarity double").repartition(3)
    got = sorted([(r["doc_id"] or 0, r["license"], r["via"]) for r in licenses.scan(df).collect()], key=str)
    assert got == sorted([(1, "Apache-2.0", "file"), (2, "GPL-3.0", "inherited"), (3, "GPL-3.0", "file"), (4, "MIT", "header"), (5, None, None), (6, None, None), (7, "Apache-2.0", "inherited"), (7, "Apache-2.0", "inherited"), (0, "GPL-3.0", "inherited"), (8, None, None), (9, "Proprietary", "header")], key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_texts_of_licences(spark):
    wrap = lambda t, lead="": "\n".join(lead + " ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    mit = max((t for n, t in licenses.BODIES if n == "MIT"), key=len)
    mpl = max((t for n, t in licenses.BODIES if n == "MPL-2.0"), key=len)
    rows = [
        ("MIT", "mit/LICENSE", f"MIT License\n\nCopyright (c) 2024 Some Body\n\n{wrap(mit)}\n"),
        ("MIT", "a.py", "# SPDX-License-Identifier: MIT\nimport os"),
        ("Apache-2.0", "b.py", "// SPDX-License-Identifier: Apache-2.0\n"),
        ("MPL-2.0", "c.js", f"/*\n{wrap(mpl, ' * ')}\n */\nvar x = 1;"),
        ("Proprietary", "d.txt", "Copyright (c) 2024 X. All rights reserved."),
        ("GPL-2.0", "two/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Everyone is permitted to copy and distribute verbatim copies."),
        ("GPL-3.0", "three/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies."),
        ("GPL-3.0", "three/deep/er/x.c", "int main;"),
        (None, "e.md", "The licence of the software is to be said."),
        (None, "f.md", "SPDX-License-Identifier: Unheard-Of"),
    ]
    df = spark.createDataFrame([(k, p, t) for k, (_, p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [got[k]["license"] for k in range(len(rows))] == [n for n, _, _ in rows]
    assert {got[0]["via"], got[5]["via"], got[6]["via"]} == {"file"} and got[7]["via"] == "inherited"


def test_inheritance_against_brute_force(spark, monkeypatch):
    """With a directory that most files lie below; joined by broadcast and by shuffles."""
    rng = random.Random(12)
    rows = []
    for k in range(400):
        depth = rng.choice([0, 1, 1, 2, 3, 5])
        at = "/".join(["hot" if i == 0 and rng.random() < 0.8 else rng.choice("ab") for i in range(depth)])
        given = rng.random() < 0.08
        rows.append((k, f"{at}/" * bool(at) + (f"LICENSE{k}" if given else f"f{k}"), rng.choice(["Released under the MIT License.", "Licensed under CC BY 4.0."]) if given else "x"))
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    own = {k: "MIT" if "MIT" in t else "CC-BY-4.0" for k, p, t in rows if t != "x"}
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    by = {}
    for k, p, _ in rows:
        if k in own:
            by[folder(p)] = min(own[k], by.get(folder(p), own[k]))

    def want(k, p):
        if k in own:
            return own[k], "file"
        d = folder(p)
        while d and d not in by:
            d = folder(d)
        return (by[d], "inherited") if d in by else (None, None)

    for few in (1_000_000, 0):
        monkeypatch.setattr(licenses, "FEW", few)
        assert {r["doc_id"]: (r["license"], r["via"]) for r in licenses.scan(df).collect()} == {k: want(k, p) for k, p, _ in rows}


def test_every_line_within_the_threshold_is_compared(spark):
    idf, unknown, rows = licenses.weights(licenses.TEMPLATES)

    def cosine(line):
        bag = licenses.terms_of(line)
        v = {w: (1 + math.log(bag.count(w))) * idf.get(w, unknown) for w in set(bag)}
        dots = {}
        for k, _, w, x in rows:
            dots[k] = dots.get(k, 0.0) + v.get(w, 0.0) * x
        return max(dots.values()) / math.sqrt(sum(x * x for x in v.values())) if bag else 0.0

    rng, some = random.Random(6), set(licenses.telling(licenses.TEMPLATES, 0.6))
    lines = ["This Source Code Form is subject to the terms of the Mozilla Public", "Mit.", "", "--", "the " * 3000]
    for _, t in licenses.TEMPLATES:
        words = t.split()
        for _ in range(6):
            lines.append(" ".join([w for w in words if rng.random() < 0.8] + ["qux"] * rng.randint(0, 3) + [rng.choice(words)] * rng.randint(0, 40)))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").withColumn("path", F.lit("x"))
    got = {r["doc_id"]: r["similarity"] for r in licenses.scan(df).collect() if r["license"]}
    assert got == {k: pytest.approx(cosine(x), abs=2e-6) for k, x in enumerate(lines) if round(cosine(x), 6) >= 0.6}
    assert 0 in got and len(got) > 100 and all(some & set(licenses.terms_of(lines[k])) for k in got)
    assert not some & set("by the of and to in a thing of which the people and the land are made".split())


def test_a_small_source_with_a_target_keeps_its_share(spark):
    rows = [(k, "word " * 20000, "big") for k in range(4)] + [(9, "one two", "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, targets={"big": 0.5, "small": 0.5}, length=64, window=64, with_ids=False).collect()
    assert {r["sequence_id"] for r in got if r["source"] == "small"} == {0}


def test_places_are_those_of_deficits_that_are_carried():
    """Every token has a place of its own, in its queue's order, and no window is off the mixture by more than two tokens for each queue."""
    rng = random.Random(9)
    for _ in range(60):
        totals = {q: rng.choice([1, 2, rng.randint(1, 60), rng.randint(1, 900)]) for q in "abcdef"[: rng.randint(1, 6)]}
        window, total = rng.randint(1, 90), sum(totals.values())
        plan, place = packing.Plan(totals, None, window), {}
        for q, n in totals.items():
            cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(3))})
            for x, y in zip(cuts, cuts[1:]):
                for done, size, pos in plan.places(q, x, y - x):
                    place.update({pos + i: (q, x + done + i) for i in range(size)})
        order = [place[i] for i in range(total)]
        for q, n in totals.items():
            assert [y for p, y in order if p == q] == list(range(n))
            for c in range(0, total, window):
                some = order[c : c + window]
                assert abs(sum(p == q for p, _ in some) - len(some) * n / total) < 2 * len(totals)


def test_sources_of_a_class():
    rng = random.Random(10)
    for _ in range(30):
        sizes = [rng.randint(64, 127) for _ in range(rng.randint(1, 9))]
        total, window = sum(sizes), packing.QUANTUM * len(sizes)
        at, low = [], 0
        for n in sizes:
            at += [(pos + i, low, done + i) for done, size, pos in packing.spread(0, n, window, low, low + n, total) for i in range(size)]
            low += n
        assert [p for p, _, _ in sorted(at)] == list(range(total)) and all([y for _, q, y in sorted(at) if q == k] == list(range(n)) for k, n in zip(np.cumsum([0, *sizes]), sizes))


def test_every_sequence_has_the_mixture_however_many_sources(spark):
    rng = random.Random(3)
    sizes = [("big", 20), ("middle", 9), (None, 6), ("*", 4)] + [(f"tail{i:02d}", 1) for i in range(30)]
    rows = [(k, "word " * (700 if n > 1 else rng.randint(5, 90)), s) for k, (s, n) in enumerate((s, n) for s, n in sizes for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    pieces = [r.asDict() for r in packing.pack(df, length=512, with_ids=False).collect()]
    total, per = sum(r["length"] for r in pieces), {}
    for r in pieces:
        per.setdefault(r["sequence_id"], {}).setdefault(r["source"], []).append(r["length"])
    for source, n in sizes[:4]:
        share = sum(r["length"] for r in pieces if r["source"] == source) / total
        for k in range(len(per) - 1):
            assert abs(sum(per[k].get(source, [])) / 512 - share) < 0.03, (source, k)
    tail = [sum(sum(x) for s, x in per[k].items() if s and s.startswith("tail")) for k in range(len(per) - 1)]
    assert max(tail) - min(tail) <= 40
    assert min(len(per[k]) for k in range(len(per) - 1)) >= 5
    assert sum(len(x) for v in per.values() for s, x in v.items() if s and s.startswith("tail")) < 30 * 8  # not token by token
