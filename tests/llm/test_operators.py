"""Each operator on small tables with nulls, empty and odd texts, repeated rows and extra columns, against plain brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, graph, language, lmscore, media, minhash, packing, pii, suffixes, textarrays, tokencount, toxicity
from ledgerline.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bin long"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(1, 9))) for _ in range(n))


BASE = [prose(i, 120) for i in range(6)]
TEXTS = [*BASE, BASE[0], BASE[1].replace(" ", "  ", 5), BASE[2] + " tail", " ".join(BASE[3].split()[:60] + BASE[4].split()[:60]), None, "", "  \n", "one", "one two", "Ünï cödé — 日本 <|endoftext|>", prose(99, 30_000), BASE[0].upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "k", 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_are_by_content():
    batch = pa.record_batch({"text": pa.array(["a b", None, "", "b  a\tb", "A"])})
    seen = []
    for _, buf, offsets in textarrays.text_slices(batch, "text", 4):
        start, end, first = textarrays.word_spans(buf, offsets)
        h = textarrays.span_hash(textarrays.prefix_hash(buf, lower=True), start, end)
        seen += [h[first[i] : first[i + 1]].tolist() for i in range(len(offsets) - 1)]
    a, b = seen[0]
    assert seen == [[a, b], [], [], [b, a, b], [a]]


def brute_repeats(texts, length):
    count = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    masks = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                m[k : k + length] = True
        masks.append(m)
    return masks


def test_suffix_core_against_brute_force(monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD", 7)
    for trial in range(20):
        rng = random.Random(trial)
        length = rng.choice([40, 48, 60])
        base = [bytes(rng.choice(b"ab") if trial % 2 else rng.randrange(97, 123) for _ in range(rng.randrange(1, 300))) for _ in range(5)]
        texts = [b"".join(rng.choice(base)[a : a + rng.randrange(1, 200)] for a in [rng.randrange(0, 100) for _ in range(rng.randrange(0, 5))]) for _ in range(30)] + [b"a" * 150, b"ab" * 90]
        t, h, _, p, s, e = suffixes.anchor_runs(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), length)
        got = [np.zeros(len(x), bool) for x in texts]
        if len(t):
            data = [texts[i][x : y + length] for i, x, y in zip(t, s, e, strict=True)]
            r, a, b = suffixes.repeated_starts(h, p - s, e - s + 1, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), length)
            for i, x, y in zip(r, a, b, strict=True):
                got[t[i]][s[i] + x : s[i] + y + length] = True
        assert all((g == w).all() for g, w in zip(got, brute_repeats(texts, length), strict=True))


@pytest.mark.parametrize("crowd,widths", [(2048, (24, 1)), (2, (24, 1)), (1, (7, 1))])
def test_suffix_dedup(spark, docs, empty, monkeypatch, crowd, widths):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes._repeats, "__defaults__", (widths,))
    rng = random.Random(8)
    shared = prose(81, 60)
    # a passage in many documents, cut at other places; text of one byte and of two; rows without an id
    more = [prose(600 + i, 20) + shared[rng.randrange(60) : len(shared) - rng.randrange(60)] + prose(700 + i, 20) for i in range(12)] + ["a" * 700, "ab" * 400]
    rows = [(len(TEXTS) + i, t, "en", "s", 1, "k", 7) for i, t in enumerate(more)] + [(None, t, "en", "s", 1, "k", 7) for t in (BASE[5][:300] + prose(650, 30), prose(651, 30) + BASE[5][:300], more[0])]
    all_docs = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    every = [*[(i, t) for i, t in enumerate(TEXTS)], (3, TEXTS[3]), *[(r[0], r[1]) for r in rows]]
    texts = [(t or "").encode() for _, t in every]
    want = []
    for (i, _), raw, m in zip(every, texts, brute_repeats(texts, 100), strict=True):
        kept = bytes(b for b, gone in zip(raw, m, strict=True) if not gone)
        want.append((i if i is not None else -1, len(raw), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, *r[1:]) for r in suffixes.remove_repeats(all_docs, 100).collect()]
    assert sorted(got) == sorted(want)
    assert suffixes.remove_repeats(empty).count() == 0


def test_suffix_dedup_after_a_very_long_text(spark):
    texts = [prose(71, 1_700_000), prose(72, 100) + BASE[0] + prose(73, 100), BASE[0] + prose(74, 100), prose(75, 60_000)]
    assert len(texts[0]) > 1 << 23
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(df, 100).collect()}
    assert got == {i: int(m.sum()) for i, m in enumerate([np.zeros(1), *brute_repeats(texts[1:3], 100), np.zeros(1)])} and got[1] > 400
    batch = pa.record_batch({"text": pa.array(["a", "b" * 9, "c", "d"])})
    assert [part.num_rows for part, _, _ in textarrays.text_slices(batch, "text", 8)] == [1, 1, 2]


def test_lm_scores(docs, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    got = lmscore.score(docs, path).collect()
    assert len(got) == len(TEXTS) + 1
    trains = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(TEXTS))]
    count = collections.Counter()
    for i in [*range(len(TEXTS)), 3]:
        if trains[i]:
            count.update([*words(TEXTS[i]), "</e>"])
    n, v = sum(count.values()), len(count)
    for r in got:
        own = [*words(TEXTS[r["doc_id"]]), "</e>"]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not trains[r["doc_id"]], len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert lmscore.score(empty, path).count() == 0


def test_lattice_sums_all_segmentations():
    logp = {"▁": -1.0, "▁a": -1.5, "a": -0.7, "b": -0.9, "ab": -1.1, "▁ab": -2.0, lmscore.END: -1.0}

    def brute(text):
        return 1.0 if not text else sum(10 ** logp[text[:k]] * brute(text[k:]) for k in range(1, len(text) + 1) if text[:k] in logp)

    for w in ("a", "ab", "abab", "ba", "aabba"):
        assert math.isclose(10 ** lmscore.Lattice(logp).word(w), brute("▁" + w), rel_tol=1e-12)


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("crowd,block,block_bytes,spread", [(32, 512, 16 << 20, 4096), (1, 8, 16 << 20, 2), (1, 10**6, 3000, 1)])
def test_minhash(spark, docs, empty, monkeypatch, crowd, block, block_bytes, spread):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(minhash, "SPREAD", spread)
    monkeypatch.setattr(minhash, "SMALL", 5 * spread)
    rng = random.Random(3)
    near = []
    for _ in range(25):  # near copies of one text, some of which link only through others
        w = BASE[5].split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(1000))
        near.append(" ".join(w))
    texts = [*TEXTS, *near]
    more = spark.createDataFrame([(len(TEXTS) + i, t, "en", "s", 1, "k", 7) for i, t in enumerate(near)], SCHEMA)
    n, comp = brute_components(texts, 3, 85)
    for r in minhash.near_duplicates(docs.unionByName(more), 3, 85).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (n[i], comp[i], comp[i] == i)
    assert minhash.near_duplicates(empty, 3, 85).count() == 0 and minhash.without_near_duplicates(empty).count() == 0


def test_minhash_keeps_one_of_each(spark):
    """Rows without an id, an id with several texts, repeated rows, clashing columns."""
    near = BASE[0] + " end"
    rows = [(1, near, "x"), (2, BASE[0], "y"), (2, prose(31, 80), "z"), (None, BASE[0], "n"), (None, BASE[1], "m"), (None, BASE[1], "m"), (5, None, "e"), (5, None, "e"), (6, None, "f"), (7, BASE[2], "g"), (7, BASE[2], "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_0 string").repartition(4)
    got = minhash.without_near_duplicates(df)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    assert got.columns == df.columns
    assert kept == sorted([(1, near), (2, prose(31, 80)), (0, BASE[1]), (5, ""), (6, ""), (7, BASE[2])])
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert (1, 1, True) in found and (2, 1, False) in found and (2, 2, True) in found and (None, 1, None) in found and (None, None, None) in found


@pytest.mark.parametrize("spread", [1, 2, 100])
def test_minhash_hubs(spark, monkeypatch, spread):
    """Every pair meets once with its own values, whether one, both or no side is a hub; hubs are dealt over salts."""
    monkeypatch.setattr(minhash, "SPREAD", spread)
    pairs = [(0, i) for i in range(1, 8)] + [(i, 9) for i in range(5)] + [(20, 21), (-4, 0)]
    pairs = spark.createDataFrame(pairs, "a long, b long")
    facts = spark.createDataFrame([(i, f"v{i}") for i in range(-5, 30)], "cls long, value string")
    ends = minhash._ends(pairs)
    links = {r["cls"]: r["links"] for r in ends.collect()}
    assert links[0] == 9 and links[9] == 5 and links[20] == 1
    got = minhash._meet(pairs, ends, facts).collect()
    assert sorted(tuple(sorted((r["a"], r["b"]))) for r in got) == sorted(tuple(sorted(r)) for r in pairs.collect())
    for r in got:
        assert (r["va"], r["vb"]) == (f"v{r['a']}", f"v{r['b']}")
        assert links[r["b"]] <= spread or links[r["a"]] <= links[r["b"]]


def test_minhash_leaves_no_tables(spark, docs):
    """What is left in the shared folder is what the result reads."""
    from pathlib import Path

    from ledgerline.llm.storage import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    out = minhash.near_duplicates(docs, 3, 85)
    assert sorted(x.name.rsplit("-", 1)[0] for x in set(folder.iterdir()) - before) == ["decided", "smallest"]
    assert out.count() == len(TEXTS) + 1


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in graph.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


KEY = "a test's key"
PII = {
    "card 4111111111111111.": True, "card 4111111111111112.": False, "ssn 123-45-6789": True, "ssn 000-45-6789": False, "call +1 (988) 555-2485 now": True, "ip 10.20.30.40": True, "ip 310.20.30.40": False, "iban GB82 WEST 1234 5698 7654 32": True, "iban GB83 WEST 1234 5698 7654 32": False,
    "born 1984-02-29": True, "born 1983-02-29": False, "on 7/4/1976 or 31.12.1999": True, "a@b.example.com": True, "order 12 of 30": False, "": False,
}


def test_pii(spark, docs, empty):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*PII, None])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.mask_report(df, KEY).collect()}
    for i, (t, changes) in enumerate(PII.items()):
        new = rows[i]["text"]
        assert (new != t) == changes and (rows[i]["n_numbers"] + rows[i]["n_dates"] > 0) == changes
        if changes and "ip" not in t and "/" not in t:  # same marks at the same places
            assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", new))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", t)))
    assert rows[len(PII)]["text"] is None
    linked = spark.createDataFrame([(0, "4111 1111 1111 1111 on 31.12.1999"), (1, "4111111111111111 on 1999-12-31")], "doc_id long, text string")
    a, b = (r["text"] for r in pii.mask_report(linked, KEY).orderBy("doc_id").collect())
    assert a[:19].replace(" ", "") == b[:16] and a[-10:].split(".")[::-1] == b[-10:].split("-")
    assert pii.mask(docs, KEY).columns == docs.columns and pii.mask(empty, KEY).count() == 0


def test_pii_cards_and_ibans_among_other_groups(spark):
    solid, visa, amex, de = "4111111111111111", "4111 1111 1111 1111", "378282246310005", "DE89 3704 0044 0532 0130 00"
    maestro = next(f"6304 0000 0000 0000 {k:03}" for k in range(999) if sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(f"6304000000000000{k:03}"[::-1])) % 10 == 0)
    xx = next(f"XX{k:02} 3704 0044 0532 0130 00" for k in range(2, 99) if int(f"3704004405320130003333{k:02}") % 97 == 1)
    cases = [
        [visa, " 12/25"], [solid, " 123"], ["ref 12 ", visa, " now"], ["2 ", visa, " 8"], [visa, " 123 ", "5500 0000 0000 0004"], [amex, " ", visa, " ", "5500 0000 0000 0004"], [maestro, " ", visa], [solid, " 12 25 ", visa],
        [visa, " ", "123-45-6789"], [solid, " ", "31.12.1999"], [visa, " ", "988 555-2485"], [visa, " ", "10.20.30.40"], [de, " BIC COBADEFF"], [de.replace(" ", ""), " EUR"], [de, " ", "123-45-6789"], [de, " ", "GB82 WEST 1234 5698 7654 32"], [de, " ", visa], [xx, " BIC"], [xx, " ", "123-45-6789"],
    ]
    values = sorted({p for c in cases for p in c if len(p) > 9 and re.search(r"\d\d", p)})
    single = {p: r["text"] for p, r in zip(values, pii.mask_report(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string"), KEY).orderBy("doc_id").collect(), strict=True)}
    assert all(new != p for p, new in single.items())
    got = [r["text"] for r in pii.mask_report(spark.createDataFrame([(i, "".join(c)) for i, c in enumerate(cases)], "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    assert got == ["".join(single.get(p, p) for p in c) for c in cases]


def test_pii_permutes(spark):
    days = spark.range(73049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(pii.date(F.col("d"), "k").alias("e")).filter("e is not null").distinct().count() == 73049
    assert spark.range(10_000).select(pii.permute_text(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "x").alias("e")).filter("e rlike '^[0-9]{4}$'").distinct().count() == 10_000
    assert spark.range(20_000).select(pii.permute_number(F.col("id"), 100, 200, "k", "x").alias("e")).filter("e between 0 and 19999").distinct().count() == 20_000


def plain_feistel(value, a, b, key, kind, rounds=8):
    """A second writing of the permutation: halves move in turns by a digest of the other."""
    left, right = divmod(value, b)
    for i in range(rounds):
        move = lambda half: int(hashlib.sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        if i % 2 == 0:
            left = (left + move(right)) % a
        else:
            right = (right + move(left)) % b
    return left * b + right


def test_pii_against_a_plain_feistel(spark):
    got = spark.range(500).select(pii.permute_number(F.col("id"), 100, 200, "k", "x").alias("e")).collect()
    assert [r["e"] for r in got] == [plain_feistel(i, 100, 200, "k", "x") for i in range(500)]
    rows = [f"{a:03}-{b:02}-{c:04}" for a, b, c in [(1, 1, 1), (665, 7, 9), (667, 99, 9999), (899, 50, 1234)]]
    want = []
    for x in rows:
        area, group, serial = map(int, x.split("-"))
        v = plain_feistel(((area - (2 if area > 666 else 1)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, KEY, "ssn")
        high, s = divmod(v, 9999)
        a, g = divmod(high, 99)
        want.append(f"no {a + (2 if a >= 665 else 1):03}-{g + 1:02}-{s + 1:04}, {x}x")
    df = spark.createDataFrame([(None, f"no {x}, {x}x", "u", 1) for x in rows] + [(1, "y" * 200_000 + f" {rows[0]}", "u", 2)] * 2, "doc_id long, text string, own_0 string, OWN_1 int").coalesce(1)
    out = pii.mask(df, KEY)
    assert out.columns == df.columns
    got = out.collect()
    assert [r["text"] for r in got[:4]] == want and got[4] == got[5] and got[4]["text"][:200_001] == "y" * 200_000 + " " and got[4]["own_0"] == "u"


def test_language(spark, empty):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(40))
    rows = [(i, make("abcdefgh" if i % 2 else "mnopqrst"), "aa" if i % 2 else "mm") for i in range(120)] + [(200, None, "aa"), (201, "12 !?", "mm"), (202, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(df, language.fit(df)).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] and 0 <= got[i]["score"] <= 1 for i in range(120))
    assert [got[i]["lang_pred"] for i in (200, 201)] == ["und", "und"] and got[202]["lang_pred"] == "aa"
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert {r["lang_pred"] for r in language.identify(df, language.fit(empty)).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    model = language.train(["abab abba", "bab"])
    codes, first = language.characters("ab", np.array([2]))
    total = 0.0
    for c in " ab":
        own, f = language.characters("ab" + c, np.array([3])) if c != " " else (np.append(codes, 32).astype(np.uint32), np.array([0, 4]))
        full = language.grams(own, f)
        total += model.prob(full, language.contexts_of(full, f, own))[-1]
    assert 0.95 < total <= 1.0001  # the rest is kept for letters never seen


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_token_counts(docs, empty, monkeypatch, block):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokencount, "SUPER", 4)
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    got = tokencount.count_tokens(docs, tokenizer_path(), block_bytes=block).collect()
    assert len(got) == len(TEXTS) + 1
    assert all(r["n_tokens"] == len(plain.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids) for r in got)
    assert tokencount.count_tokens(empty, tokenizer_path()).count() == 0


def test_token_counts_without_ids(spark):
    """A null id stays null, beside a real -1."""
    rows = spark.createDataFrame([(-1, "a b c"), (None, "d"), (None, None), (-(2**63), "")], "doc_id long, text string")
    got = [tuple(r) for r in tokencount.count_tokens(rows, tokenizer_path()).collect()]
    assert collections.Counter(got) == {(-1, 3): 1, (None, 1): 1, (None, 0): 1, (-(2**63), 0): 1}


@pytest.mark.parametrize("block", [2, 10, 1 << 20])
def test_existing_flat_files(spark, tmp_path, monkeypatch, block):
    """Several files in nested folders: documents over many blocks, empty ones, a last one that isn't ended, an empty file."""
    monkeypatch.setattr(tokencount, "SUPER", 4)
    rng, want = random.Random(5), {}
    for k, (lengths, ended) in enumerate([([3, 0, 0, 41, 1], True), ([0], True), ([17], False), ([5, 0, 2], False), ([], True), ([0, 0, 60, 4], True)]):
        ids = [x for n in lengths for x in (*(rng.randrange(9) for _ in range(n)), 9)]
        path = tmp_path / f"part {k % 2}" / f"{k}.bin"
        path.parent.mkdir(exist_ok=True)
        np.array(ids if ended else ids[:-1], "<u2").tofile(path)
        want[path.name] = list(enumerate(lengths))
    blocks = tokencount.read_flat(spark, f"{tmp_path}/*", block)
    got = collections.defaultdict(list)
    for r in tokencount.stitch(tokencount.scan_blocks(blocks, 9)).collect():
        got[r["file"]].append((r["ordinal"], r["n_tokens"]))
    assert sorted(sorted(x) for x in got.values()) == sorted(x for x in want.values() if x)


def test_decontamination(spark, docs, empty):
    items = [(i, prose(1000 + i, 36)) for i in range(12)]
    bench = spark.createDataFrame([*items, (50, None), (51, "")], "item_id long, text string")
    w = items[3][1].split()
    para = " ".join(x if k % 5 else "zzz" for k, x in enumerate(w))
    rows = [(0, BASE[0] + " " + items[0][1] + " " + BASE[1]), (1, BASE[2]), (2, items[1][1].upper()), (3, prose(7, 40) + " " + para), (4, " ".join(w[:6]) + " " + BASE[3]), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {0: (True, 0), 1: (False, None), 2: (True, 1), 3: (True, 3), 4: (False, None), 5: (False, None), 6: (False, None)}
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(df, bench).collect()) == [1, 4, 5, 6]
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == len(TEXTS) + 1
    assert decontaminate.leaks(empty, bench).count() == 0


def test_decontamination_beyond_the_basis(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "RANK", 4)
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 40)
    items = [(i, prose(2000 + i, 12 if i % 2 else 36)) for i in range(120)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, prose(3000 + i, 40 + i % 16) + " " + t + " " + prose(4000 + i, 60)) for i, t in items] + [(200 + i, prose(5000 + i, 150)) for i in range(40)]
    df = spark.createDataFrame([*rows, (None, items[0][1]), (None, prose(1, 90)), rows[5]], "doc_id long, text string")
    got = decontaminate.leaks(df, bench).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in got if r["contaminated"] and r["doc_id"] != 0) == sorted([(-1, 0), (5, 5), *((i, i) for i, _ in items[1:])])
    assert [r["item_id"] for r in got if r["doc_id"] == 0] == [0] and len(got) == len(rows) + 3
    assert sorted(r["doc_id"] or -1 for r in decontaminate.without_leaks(df, bench).collect()) == [-1, *range(200, 240)]


def planted(n, share, seed, corpus):
    """(items, texts): texts hold one item each, of whose words a share are others of the corpus, between words of the corpus."""
    rng = random.Random(seed)
    words_in = [w for t in corpus for w in t.split()]
    items = [" ".join(rng.choices(words_in, k=rng.randrange(15, 60))) for _ in range(n)]
    texts = []
    for i in range(min(n, 150)):
        w = [rng.choice(words_in) if rng.random() < share else x for x in items[i].split()]
        texts.append(" ".join(rng.choices(words_in, k=rng.randrange(0, 70)) + w + rng.choices(words_in, k=rng.randrange(0, 70))))
    return items, texts


def exhaustive(items, texts, verbatim=0.75, paraphrase=0.5, answer=0.6):
    """Which items each text leaks by the subsequence and answer rules alone, every item compared with every passage."""
    hashed = lambda t: decontaminate.words_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    own = [hashed(t) for t in items]
    counts = np.bincount(np.concatenate([np.unique(decontaminate.feature(hashed(t))) for t in texts]), minlength=decontaminate.FEATURES)
    out = []
    for t in texts:
        h, found = hashed(t), set()
        for k, w in enumerate(own):
            rare = set(np.unique(w[np.argsort(counts[decontaminate.feature(w)], kind="stable")[: max(2, len(w) // 3)]]).tolist())
            for at in range(0, len(h), decontaminate.STEP):
                text = h[max(0, at - decontaminate.STEP) : at + max(decontaminate.WINDOW, len(w)) + decontaminate.STEP].tolist()
                told = len(rare & set(text)) / len(rare)
                if not told or len(set(w.tolist()) & set(text)) < paraphrase * len(set(w.tolist())) * 0.5:
                    continue
                lcs = decontaminate.lcs_length(w.tolist(), text) / len(w)
                if lcs >= verbatim or lcs >= paraphrase and told >= answer:
                    found.add(k)
        out.append(found)
    return out


@pytest.mark.parametrize("share", [0.0, 0.2, 0.35])
def test_retrieval_against_exhaustive_search(spark, share):
    corpus = [prose(i, 400) for i in range(40)]
    items, texts = planted(200, share, 3, corpus)
    texts += [prose(6000 + i, 200) for i in range(30)]
    want = exhaustive(items, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), bench).collect()}
    due = [i for i, w in enumerate(want) if w]
    assert len(due) >= 40 and sum(got[i]["contaminated"] for i in due) >= 0.95 * len(due)
    assert not any(r["contaminated"] and r["item_id"] not in want[i] for i, r in got.items())


def test_candidates_come_from_the_latent_space(spark, monkeypatch):
    corpus = [prose(i, 400) for i in range(40)]
    items, texts = planted(60, 0.2, 4, corpus)
    texts += items[:5]
    bench, docs = spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: {r["doc_id"] for r in decontaminate.leaks(docs, bench).collect() if r["contaminated"]}
    every = found()
    monkeypatch.setattr(decontaminate, "latent_basis", lambda *a: np.zeros((decontaminate.FEATURES, 8), np.float32))
    assert len(every) > 50 and found() == set(range(60, 65))  # whole items need no cosine


def test_decontamination_of_long_and_nameless_rows(spark):
    item = prose(77, 40)
    rows = [(None, prose(1, 300_000) + " " + item + " " + prose(2, 10)), (None, prose(3, 50)), (None, prose(3, 50)), (7, item + " x"), (7, item + " x"), (7, prose(4, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as item_id", "text as lcs", "1 as cosine")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.leaks(docs.select("doc_id", "text"), bench).collect()
    assert sorted((r["doc_id"] or 0, r["contaminated"]) for r in got) == [(0, False), (0, False), (0, True), (7, False), (7, True), (7, True)]
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 3


def test_lcs():
    for seed in range(50):
        rng = random.Random(seed)
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs_length(a, b) == t[-1][-1]


def test_toxicity(spark, empty):
    rows = [(i, prose(i, 15) + (" moronic fool" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)]
    df = spark.createDataFrame([(i, t, "moron") for i, t, _ in rows] + [(900, None, ""), (901, "", ""), (902, prose(5, 15) + " mmoronic foool", "")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    held = [i for i in range(240) if got[i]["held_out"]]
    pos, neg = (np.array([got[i]["score"] for i in held if rows[i][2] == y]) for y in (1, 0))
    assert len(pos) and len(neg) and (pos[:, None] > neg).mean() >= 0.9
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i]["score"] <= 1 for i in got)
    assert got[902]["score"] > got[901]["score"] == got[900]["score"]
    assert {r["predicted"] for r in toxicity.score(df, toxicity.fit(df, labels.limit(0))).collect()} == {0}
    assert toxicity.clean_documents(df, labels).columns == df.columns and toxicity.score(empty, toxicity.fit(df, labels)).count() == 0


def test_toxicity_log_odds_stay_finite():
    """Probabilities that round to 0 or 1 must not spoil the threshold."""
    kinds = toxicity.Subwords()
    model = toxicity.Model(kinds, np.random.default_rng(0).normal(0, 1e5, kinds.buckets), 0.0, 0.3)
    texts = [prose(i, 20) for i in range(40)] + ["", " 12 "]
    x, n = toxicity.logits(model, texts)
    assert np.isfinite(x).all() and np.abs(x[:40]).max() > 1000
    fitted = toxicity.calibrate(model, x[:40], n[:40], (x[:40] > 0).astype(float), np.ones(40))
    assert np.isfinite(fitted.weight).all() and np.isfinite(fitted.bias)
    raw = [t.encode() for t in texts]
    scores = fitted.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert ((scores >= 0) & (scores <= 1)).all() and scores[40:].tolist() == [0.3, 0.3]
    assert ((scores[:40] >= 0.5) == (x[:40] > 0)).mean() >= 0.9


def plain_log_odds(model, text):
    """A text's highest window, one word and one n-gram at a time."""
    letters = [chr(b).lower() if chr(b).isascii() and chr(b).isalpha() else chr(b) if b >= 128 else " " for b in text.encode()]
    raw = bytearray(ord(c) for c in letters)
    for i in range(1, len(raw)):
        if text.encode()[i - 1] == 0xC3 and 0x80 <= text.encode()[i] <= 0x9E:
            raw[i] += 32

    def bucket(gram):
        h = sum(int(textarrays._BYTE[b]) * textarrays._R**i for i, b in enumerate(gram)) % 2**64
        return int(textarrays.mix(np.array([h ^ len(gram) * 0xD6E8FEB86659FD93 % 2**64], np.uint64))[0]) % model.subwords.buckets

    scores = []
    for w in bytes(raw).split(b" "):
        if w:
            marked = b" " + w + b" "
            grams = [marked] + [marked[i : i + n] for n in model.subwords.sizes if n != len(marked) for i in range(len(marked) - n + 1)]
            scores.append(np.mean([model.weight[bucket(g)] for g in grams]))
    starts = range(0, max(1, len(scores) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
    means = [np.mean(scores[a : a + toxicity.WINDOW]) for a in starts] if scores else []
    return max(means) + model.bias + model.length * math.log(len(means)) if means else None


def test_toxicity_against_plain_writing():
    kinds = toxicity.Subwords()
    model = toxicity.Model(kinds, np.random.default_rng(1).normal(0, 1, kinds.buckets), 0.4, 0.2, -0.3)
    texts = [None, "", "a", "A b", "one two three", "one two three four", "It's five-words: right? Yes", "ÀÉÎ naïve 日本 Straße", prose(1, 9), prose(2, 10), prose(3, 57), " 12 "]
    z, n = toxicity.logits(model, [t or "" for t in texts])
    for t, x, k in zip(texts, z, n, strict=True):
        want = plain_log_odds(model, t or "")
        assert (want is None) == (k == 0) and (want is None or abs(want - x) < 1e-9)


def test_toxicity_in_long_texts(spark):
    """A few words in a long text, repeated rows, texts without letters and columns of clashing names."""
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randrange(20, 200)), int(i % 4 == 0)) for i in range(300)]
    rows = [(i, t.replace(" ", " moronic fool ", 1) if y else t, y) for i, t, y in rows]
    long = " ".join(prose(5000 + i, 300) for i in range(20))
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, long + " moronic fool " + long, "x"), (901, long, "x"), (901, long, "x"), (902, "12 34", "x"), (None, "moronic fool", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, labels)).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 305 and by[900] > by[901] and by[None] > 0.5
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    pos, neg = (np.array([by[i] for i in held if rows[i][2] == y]) for y in (1, 0))
    assert (pos[:, None] > neg).mean() >= 0.9


def test_audio(docs, empty):
    got = media.audio_summary(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        raw = (TEXTS[r["doc_id"]] or "").encode()
        want = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert media.read_back(media.store(want)) == want and r["media_bytes"] == len(want) + 44
    by = {r["doc_id"]: r["feature"] for r in got}
    assert by[0] == by[6] and by[0] != by[1]
    tensors = media.audio_tensors(docs.filter("doc_id = 0")).collect()
    table = pa.ipc.open_stream(tensors[0]["tensor"]).read_all()
    assert table.column("tensor").type.shape == [media.WINDOW, media.MELS] and table.column("end_ms")[0].as_py() == tensors[0]["end_ms"]
    x = np.arange(2 * media.WINDOW * media.MELS).reshape(2, media.WINDOW, media.MELS).astype(np.float16)
    back, start, end = media.read_tensors(media.store_tensors(x, *media.spans_of(2)))
    assert (back == x).all() and start[1] == end[0]
    assert media.audio_summary(empty).count() == 0


def test_audio_blocks_agree():
    x = np.random.default_rng(1).integers(0, 256, 200_000).astype(np.uint8)
    y = media.resample((x.astype(np.float32) - 128) / 128)
    mels, energy = media.log_mel(x.tobytes())
    lo = 600 * media.HOP
    frame = y[lo : lo + media.FRAME] * np.hanning(media.FRAME)
    assert abs(10 * np.log10((frame**2).mean() + 1e-9) - energy[600]) < 1e-3
    assert media.segments(np.array([0, 9, 9, 5, 0, 0, 0, 9, 0.0])) == [(20, 80), (140, 160)]


def test_special_tokens_in_both_orders():
    from tokenizers import Tokenizer

    from ledgerline.llm.wordtokens import WordTokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    texts = ["<|endoftext|> a", "<|ENDOFTEXT|> a", "x<|EndOfText|>", "<B>b<b>"]
    for own in (texts, texts[::-1]):
        tokens = WordTokenizer(tokenizer_path())
        for t in own:
            ids, first = tokens.encode(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
            assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids and first.tolist() == [0, len(ids)]


@pytest.mark.parametrize("group", [50_000, 5])
def test_packing(spark, docs, empty, group):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    from ledgerline.llm.storage import materialize

    got = packing.pack(materialize(packing.cut_pieces(docs, tokenizer_path(), 256, 1), "pieces"), 256, group_items=group).collect()
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 256 * r["piece"] and len(own) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    assert sum(r["length"] for r in got) == sum(map(len, ids.values())) + len(ids[3])
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.25 * sum(r["length"] for r in got) / 256 + 2
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_nearest_items_are_offered_in_order():
    """By the order of a partial sort before, which all passages went through whether they had as many near items or not."""
    rng = np.random.default_rng(3)
    item = [" ".join(f"w{x}" for x in rng.integers(0, 60, 30)) for _ in range(40)]
    texts = [" ".join([*item[i].split()[: 5 + i % 26], *(f"w{x}" for x in rng.integers(0, 90, i * 7 % 71))]) for i in range(40)] + ["", "w1"]
    df, idf = np.ones(decontaminate.FEATURES), np.ones(decontaminate.FEATURES, np.float32)
    basis = rng.standard_normal((decontaminate.FEATURES, 12)).astype(np.float32)
    items = decontaminate.Items(list(range(40)), item, idf, basis, df, 0.3, 0.75, 0.6)
    raw = [t.encode() for t in texts]
    h, first = decontaminate.words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    begin = np.concatenate([np.arange(a, b, decontaminate.STEP) for a, b in zip(first[:-1], first[1:], strict=True)])
    doc = np.searchsorted(first, begin, side="right") - 1
    at, _ = items.met(h)
    got = list(items.near(h, first, begin, doc, at, basis))
    want = []
    for p, a in enumerate(begin):
        if (np.searchsorted(at, min(a + items.reach.max(), first[doc[p] + 1])) - np.searchsorted(at, max(a - decontaminate.STEP, first[doc[p]]))) >= items.least:
            v = basis[decontaminate.feature(h[a : min(a + decontaminate.WINDOW, first[doc[p] + 1])])].astype(float).sum(0)
            cosines = items.vectors.astype(float) @ (v / np.sqrt((v * v).sum()))
            want += [(p, int(q)) for q in sorted(np.argsort(-cosines)[: decontaminate.NEAREST]) if cosines[q] >= 0.3]
    assert len(want) > 100 and [(p, q) for p, q, _ in got] == want
