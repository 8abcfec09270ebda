"""The operators against brute force on small fixtures, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from granary.llm import chat, classifier, decontaminate, line_dedup, quality, repeats, simhash, substring_dedup, suffix_dedup, tokens
from granary.llm.queries import ORACLES, QUERIES
from tests.compare import difference, open_tables

SCHEMA = "doc_id long, text string, lang string, source string, n_lines long, rest string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["of", "the", "and", "été", "für", "Thing", "run", "x1", "日本"] + ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, lines = prose(60), [prose(9) for _ in range(6)]
    rows = [None, "", " \n\t ", "short text", passage, passage, "aaaa" * 60, "ab " * 200, "\n" * 9]
    for i in range(30):
        rows.append(prose(rng.randint(1, 120)) + (f" {passage} " if i % 3 == 0 else "\n") + prose(20))
    for i in range(12):
        rows.append("\n".join([prose(8), *lines[i % 3 : i % 3 + 4], prose(8)]))
    base = prose(150).split()
    for i in range(90):  # more near copies than a crowd
        copy = list(base)
        copy[rng.randrange(150)] = f"changed{i % 40}"
        rows.append(" ".join(copy))
    rows.append(prose(20_000))
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", i, "r") for i, t in enumerate(texts)]
    rows += [rows[40], (None, texts[40], None, "s1", 0, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _plain(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]


def _key(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def test_suffix_dedup(docs, none):
    rows, first = _plain(docs), {}
    for d, b in rows:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], 1 << 62), _key(d))
    want = Counter()
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < _key(d):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want[d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs).collect())
    assert got == want
    assert suffix_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("shard", [substring_dedup.SHARD_WORDS, 300])
def test_substring_dedup(docs, none, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    rows = [(d, b.split()) for d, b in _plain(docs)]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    want = Counter()
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want[d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(docs).collect())
    assert got == want
    assert substring_dedup.dedup(none).count() == 0


def test_suffix_automaton_matches():
    automaton = substring_dedup.SuffixAutomaton()
    rng = random.Random(1)
    parts = [[rng.randrange(3) for _ in range(rng.randint(0, 12))] for _ in range(20)]
    for p in parts:
        automaton.add(p)
    for _ in range(50):
        probe = [rng.randrange(3) for _ in range(15)]
        for end, size in enumerate(automaton.matches(probe)):
            held = lambda n: any(probe[end + 1 - n : end + 1] == p[i : i + n] for p in parts for i in range(len(p) - n + 1))  # noqa: B023, E731
            assert held(size) and (size == end + 1 or not held(size + 1))


def test_line_dedup_keeps_other_columns(docs, none):
    out = line_dedup.dedup(docs)
    assert out.columns == [*docs.columns, "_n_lines", "n_removed_lines"]
    rows = [(r.doc_id, (r.text or "").split("\n") if r.text is not None else []) for r in docs.collect()]
    first = {}
    for d, x in rows:
        for i in range(len(x) - 2):
            k = tuple(x[i : i + 3])
            first[k] = min(first.get(k, (1 << 62, 0)), (_key(d), i))
    want = Counter()
    for d, x in rows:
        gone = [False] * len(x)
        for i in range(len(x) - 2):
            if first[tuple(x[i : i + 3])] < (_key(d), i):
                gone[i : i + 3] = [True] * 3
        want[d, "\n".join(y for y, g in zip(x, gone, strict=True) if not g), sum(gone)] += 1
    assert Counter((r.doc_id, r.text or "", r.n_removed_lines) for r in out.collect()) == want
    assert line_dedup.dedup_documents(none).columns == none.columns


def test_line_dedup_keeps_repeated_rows_without_another_twin(spark):
    text = "\n".join(f"line {i}" for i in range(6))
    rows = [(5, text), (5, text), (6, "a\nb\nc\n" + text), (None, "x\ny\nz\none"), (None, "x\ny\nz\ntwo")]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in line_dedup.dedup_documents(given).collect())
    assert got in [Counter([(5, text), (5, text), (6, "a\nb\nc"), (None, rows[i][1]), (None, rows[7 - i][1][6:])]) for i in (3, 4)]


def test_long_passages_on_few_lines_are_removed(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    pool = [prose(rng.choice([5, 24, 26, 49, 50, 70])) for _ in range(40)] + ["", " "]
    rows = [(None if i % 9 == 0 else i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 7)))) for i in range(150)]
    rows = sorted({(_key(d), t) for d, t in rows if d is not None}) + [(_key(None), rows[0][1])]
    runs = lambda x: [(i, k, tuple(x[i : i + k])) for i in range(len(x)) for k in (1, 2, 3) if i + k <= len(x) and (k == 3 or len(" ".join(x[i : i + k]).split()) >= 50)]
    first, want = {}, Counter()
    for d, t in rows:
        for i, _, r in runs(t.split("\n")):
            first[r] = min(first.get(r, (1 << 62, 0)), (d, i))
    for d, t in rows:
        x = t.split("\n")
        gone = {i + j for i, k, r in runs(x) if first[r] < (d, i) for j in range(k)}
        if len(gone) < len(x):
            want[d, "\n".join(y for i, y in enumerate(x) if i not in gone)] += 1
    given = spark.createDataFrame([(None if d == _key(None) else d, t) for d, t in rows], "doc_id long, text string")
    assert Counter((_key(r.doc_id), r.text) for r in line_dedup.dedup_documents(given).collect()) == want


def test_phrases_of_a_long_text_are_those_of_its_parts(monkeypatch):
    x = np.random.default_rng(2).integers(0, 4, 3000).astype(np.uint64) + np.uint64(1)
    whole = repeats.phrases(x, np.array([0, 3000]), 35, 12)
    monkeypatch.setattr(repeats, "_KEEP", 400)
    parts = repeats.phrases(x, np.array([0, 3000]), 35, 12)
    windows = lambda p: sorted(w for f, n in zip(p[1], p[2], strict=True) for w in range(f, f + n))
    assert windows(whole) == windows(parts) == list(range(3000 - 34))


def test_token_counts(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in tokens.count(docs, path).join(docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))
    assert tokens.count(none, path).count() == 0
    with open(path, "rb") as f:
        machine, rng = tokens.Compiled(f.read()), random.Random(3)
    bits = ["a", "'s", "'re", "'", "l", " ", "  ", "\n", "1", "²", "é", "!", "<|endoftext|>", "'v", "e", "　", "THE", "\r\n", "日本", "🙂", "'S"]
    odd = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + ["ab" * 2000]
    raw, bounds = repeats.texts_of(pa.array(odd))
    assert machine.tokens(raw, bounds).tolist() == [len(e.ids) for e in library.encode_batch(odd, add_special_tokens=False)]


def test_transitions_carry_token_counts(monkeypatch):
    """Along any bytes, the changes on the transitions add up to the library's count of every prefix; states are reused."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        machine = tokens.Compiled(f.read()).machine
    rng = random.Random(11)
    for piece in ["internationalisation", "aaaaaaaaaaaaaaaaaaaa", "abcabcabcabc", "".join(rng.choice("etaoins") for _ in range(60)), "zqxjzqxj"]:
        state = total = 0
        for i, byte in enumerate(piece.encode()):
            state, change = machine.move(state, byte)
            total += change
            assert total == len(library.encode(piece[: i + 1], add_special_tokens=False).ids), piece[: i + 1]
    before = len(machine.states)
    state = 0
    for byte in b"zqxj" * 500:
        state, _ = machine.move(state, byte)
    assert len(machine.states) < before + 60  # finite: a long piece comes back to known states
    raw, bounds = repeats.texts_of(pa.array(["".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 1, 5, 127, 128, 129, 4000)]))
    want = [len(e.ids) for e in library.encode_batch([raw[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])], add_special_tokens=False)]
    assert machine.counts(raw, bounds[:-1], bounds[1:]).tolist() == want
    monkeypatch.setattr(tokens, "STATES", 5)
    assert machine.counts(raw, bounds[:-1], bounds[1:]).tolist() == want


def _size(part):
    return len(zstandard.ZstdCompressor(level=3).compress(part))


def _band(n):
    return next((low, high) for upto, low, high in quality.BANDS.whole if n <= upto)


def _judged(text):
    """The contract's counts and the rule on bands, in plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    raw = text.encode()
    parts = [raw[i : i + 2048] for i in range(0, len(raw), 2048)]
    inside = lambda part, low, high: low <= len(part) / _size(part) <= high
    good = bool(raw) and inside(raw, *_band(len(raw)))
    good = good and all(inside(p, *(quality.BANDS.chunk_limits if len(p) == 2048 else _band(len(p)))) for p in parts)
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
    return (*counts, failed, not failed and good)


def test_compression_bands(spark, docs, none):
    rng = random.Random(12)
    noise = "".join(chr(33 + rng.randrange(90)) + (" " if i % 9 == 8 else "") for i in range(5000))
    prose = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(900))
    hidden = prose[:2300] + " pad" * 300 + prose[2300:]  # only a chunk shows it
    tail = prose[:2048] + "".join(chr(33 + rng.randrange(90)) for _ in range(700))
    more = [(5000 + i, t) for i, t in enumerate([noise, prose, hidden, tail, "# $ <a> % & | * \n" * 40, prose[:2048], prose[:2047], prose[:4096]])]
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = Counter((r.doc_id, *_judged(r.text or "")) for r in given.collect())
    got = quality.score(given).collect()
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in got) == want
    kept = {r.doc_id: r.kept for r in got}
    assert kept[5001] and not kept[5000] and not kept[5002]
    assert quality.score(none).count() == 0


def _fingerprint(text, words):
    w = text.lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(items, near):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


@pytest.mark.parametrize("crowd", [64, 3])
def test_simhash_groups(docs, none, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rows = _plain(docs)
    prints = {i: _fingerprint(b, 3) for i, (_, b) in enumerate(rows)}
    near = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]
    members = defaultdict(list)
    for i, g in _groups(prints, near).items():
        members[g].append(i)
    want = Counter()
    for group in members.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            want[rows[i][0], prints[i], min(ids, default=None)] += 1
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.groups(docs).collect())
    assert got == want
    assert simhash.groups(none).count() == 0


def test_near_copies_keep_the_first_of_each_group(docs, none):
    rows = {_key(d): b for d, b in _plain(docs)}
    sets = {}
    for d, b in rows.items():
        w = b.lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)})
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {r for i, r in _groups(sets, near).items()}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {_key(r.doc_id) for r in kept.collect()} - want == set()
    assert len(want - {_key(r.doc_id) for r in kept.collect()}) <= 1  # min-wise keys may join through a pair of null ids
    assert simhash.keep_one(none).count() == 0


def test_rows_of_one_id_and_text_have_a_defined_winner(spark):
    rows = [(1, "one and the same text", lang, {"k": n}) for lang, n in (("en", 2), ("de", 3), (None, 1), ("de", 1))]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, more map<string,int>")
    for df in (given.coalesce(1), given.repartition(4), given.orderBy("more.k")):
        assert [(r.lang, r.more["k"]) for r in simhash.keep_one(df).collect()] == [("de", 1)]
    assert simhash.keep_one(given.select("doc_id", "text")).count() == 1


def test_descent_equals_another_solver():
    """The dual solved by projected gradient steps on the whole Gram matrix gives the same weights and bias."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(30, rng.integers(3, 12), replace=False)) for _ in range(60)]
    values, sign = rng.normal(size=30), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = values[r] / np.sqrt((values[r] ** 2).sum())
        x[i, 30] = 1.0  # the bias
    gram = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, classifier.COST)
    want = (alpha * sign) @ x
    w, bias = classifier.dual_coordinate_descent(rows, values, sign, rounds=3000)
    assert np.abs(np.append(w, bias) - want).max() < 1e-4
    few, off = classifier.dual_coordinate_descent(rows, values, sign)
    objective = lambda v: 0.5 * v @ v + classifier.COST * np.maximum(1 - sign * (x @ v), 0).sum()
    assert objective(np.append(few, off)) < 1.02 * objective(want)


def test_texts_with_null_ids_and_one_32_bit_hash_stay_apart(spark):
    made = spark.range(300_000).select(F.concat(F.lit("a\nb\nc\ntext"), "id").alias("text"))
    twins = made.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).where("size(t) > 1").first().t
    given = spark.createDataFrame([(None, t) for t in twins] + [(None, "other")], "doc_id long, text string")
    assert {r.text for r in simhash.keep_one(given).collect()} == {*twins, "other"}
    out = line_dedup.dedup(given).collect()
    assert sorted(r.n_removed_lines for r in out) == [0] * 2 + [3] * (len(twins) - 1)
    assert repeats.keyed(given).select("tag").distinct().count() == len(twins) + 1


def test_near_copies_do_not_depend_on_repeats_inside_a_text(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    texts = {}
    for i in range(60):
        phrase, rest = prose(8), prose(200)
        texts[2 * i], texts[2 * i + 1] = " ".join([phrase] * 50 + [rest]), f"{phrase} {phrase} {rest}"
    given = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(given).collect()} == {2 * i for i in range(60)}
    assert simhash.near_copies(given).select("node").distinct().count() == 60  # equal sets are one node


def test_near_copies_come_from_the_groups_of_fingerprints(spark):
    """Similar texts that share no min-wise key but a group of `groups` are found, by the fingerprints that op8 returns."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(2500):
        text = " ".join([" ".join(word() for _ in range(5))] * 30 + [word() for _ in range(38)])
        texts += [text, " ".join([text, *(word() for _ in range(10))])]  # 43 of 53 distinct shingles in both
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["doc_key", "tag", "text"])
    keys = next(simhash._sketches(5)(iter([given]))).column("keys").to_pylist()
    prints = lambda i: _fingerprint(texts[i].encode(), 3)
    apart = [i for i in range(0, len(texts), 2) if not any(map(int.__eq__, keys[i], keys[i + 1]))]
    some = [i for i in apart if (prints(i) ^ prints(i + 1)).bit_count() <= 2]
    assert some
    rows = spark.createDataFrame([(j, texts[j]) for i in some for j in (i, i + 1)], "doc_id long, text string")
    assert {r.component_id for r in simhash.groups(rows).collect()} == set(some)
    assert {r.doc_id for r in simhash.keep_one(rows).collect()} == set(some)


@pytest.mark.parametrize("crowd", [64, 1])
def test_similar_texts_without_a_common_min_wise_key_are_found(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "NEAR_CROWD", crowd)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    lines = []
    for _ in range(4000):
        text = [word() for _ in range(64)]
        lines += [" ".join(text), " ".join([*text, *(word() for _ in range(rng.choice([14, 15, 16, 30])))])]  # 60 of 74 to 90 shingles
    given = pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array([0] * len(lines)), pa.array(lines)], names=["doc_key", "tag", "text"])
    keys = next(simhash._sketches(5)(iter([given]))).column("keys").to_pylist()
    apart = [i for i in range(0, len(lines), 2) if not any(map(int.__eq__, keys[i], keys[i + 1]))]
    similar = [i for i in apart if len(lines[i + 1].split()) <= 79]
    assert similar and len(apart) > len(similar)
    rows = spark.createDataFrame([(j, lines[j]) for i in apart for j in (i, i + 1)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(rows).collect()} == {*apart, *(i + 1 for i in apart)} - {i + 1 for i in similar}


@pytest.mark.parametrize("outside", [512, 2])
def test_crowds_of_near_copies_are_grouped_as_by_brute_force(spark, monkeypatch, outside):
    for name, value in {"NEAR_CROWD": 4, "LEADERS": 1, "OUTSIDE": outside}.items():
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 1, 2, 6])):
            words[at] = f"x{i}-{at}"
        texts[i] = " ".join(words)
    sets = {i: {tuple(w[j : j + 5]) for j in range(116)} for i, w in ((i, t.split()) for i, t in texts.items())}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = simhash.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(_groups(sets, near).values())


@pytest.mark.parametrize("crowd", [64, 2])
def test_small_clusters_of_one_template_are_all_found(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "NEAR_CROWD", crowd)
    rng = random.Random(8)
    template, texts = [f"t{i}" for i in range(160)], []
    for c in range(1500):
        one = template + [f"c{c}-{i}" for i in range(rng.randint(36, 44))]
        two = list(one)
        for at in rng.sample(range(160, len(one)), 4):
            two[at] = f"x{at}"
        texts += [one, two]
    lines = [" ".join(t) for t in texts]
    given = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([0] * 3000), pa.array(lines)], names=["doc_key", "tag", "text"])
    keys = next(simhash._sketches(5)(iter([given]))).column("keys").to_pylist()
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]  # two clusters share 0.7 at most
    similar = {i + 1 for i in range(0, 3000, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    proposed = {i for i in similar if any(map(int.__eq__, keys[i - 1], keys[i]))}
    assert len(proposed) > 1000
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert proposed <= set(range(3000)) - {r.doc_id for r in kept.collect()} <= similar


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "a\\e[b]<s>"), (1, 1, "user", None), (1, 2, "assistant", "</s>\n[user] x \\"), (2, 0, "assistant", "first"), (3, None, None, "x"), (3, 1, "user", "y"), (None, 0, "user", "q"), (1, 2, "assistant", "</s>\n[user] x \\")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash"))
    out = chat.format_conversations(given).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("segments")))
    got = {r.conv_id: r for r in out.collect()}
    for c, r in got.items():
        want = sorted(((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c))
        assert [(t.role, t.text) for t in r.turns] == [w[2:] for w in want]
        assert r.loss == "".join(w[3] for w in want if w[2] == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
    assert (got[2].valid, got[2].broken_at, got[None].valid, got[1].broken_at) == (False, 0, True, 3)
    with pytest.raises(ValueError):
        chat.Template(close="end")


def test_classifier_learns_and_scores_everything(spark, none):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["one", "two", "of", "tree", "river"]) + rng.choice("abc") for _ in range(60)) for _ in range(60)]
    rows = [(i, t if i % 3 else t.upper() + " ### buy", "", "", 0, "") for i, t in enumerate(good)] + [(100, None, "", "", 0, ""), (100, "", "", "", 0, ""), (None, "x", "", "", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(5, None), (None, 1), (7, 1)], "doc_id long, quality int")
    out = classifier.score(docs, classifier.fit(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == int(r.doc_id % 3 > 0) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None and r.doc_id < 60)
    empty = classifier.fit(docs, labels.where("false"))
    assert empty.constant == 1.0 and classifier.score(none, empty).count() == 0


def test_decontamination_spans_and_documents(spark, docs):
    items = spark.createDataFrame([(1, "One two, three FOUR five six seven eight nine ten eleven"), (2, "été Ünder"), (3, None), (4, "?!"), (None, "one")], "item_id long, text string")
    given = spark.createDataFrame([(1, "x ONE two three four five six seven eight nine TEN eleven. y"), (2, "été ünder"), (3, "one two"), (3, "zero"), (None, None), (5, "")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.report(given, items).collect())
    assert got == Counter([(1, 13, 11, ("1", "null")), (2, 2, 0, ()), (3, 2, 1, ("null",)), (3, 1, 0, ()), (None, 0, 0, ()), (5, 0, 0, ())])
    assert sorted(r.text or "" for r in decontaminate.clean(given, items).collect()) == ["", "", "zero", "été ünder"]
    cut = {(r.doc_id, r.text) for r in decontaminate.clean(given, items, remove="spans").collect()}
    assert (1, "x y") in cut and (3, "two") in cut and (3, "zero") in cut
    assert decontaminate.report(given, items.where("false")).where("n_hit > 0").isEmpty()


def test_benchmark_in_slices_gives_the_same(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = Counter((r.doc_id, r.n_hit) for r in decontaminate.report(docs, items).collect())
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 40_000)
    assert Counter((r.doc_id, r.n_hit) for r in decontaminate.report(docs, items).collect()) == whole


def test_windows_with_one_anchor_are_dealt_to_all_slices(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"a{i} b{i} " + "same" * 9 + f" c{i}") for i in range(400)], "item_id long, text string")
    windows = decontaminate.benchmark_windows(items)
    assert windows.select("anchor").distinct().count() == 1
    given = spark.createDataFrame([(i, f"x a{i} b{i} " + "same" * 9 + f" c{i}") for i in range(0, 900, 7)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 16_000)
    parts = [p.count() for p in decontaminate.table_slices(windows)]
    assert sum(parts) == 400 and len(parts) > 2 and max(parts) < 2 * 400 / len(parts)
    assert {r.doc_id for r in decontaminate.report(given, items).where("n_hit > 0").collect()} == set(range(0, 400, 7))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), open_tables(sf_dir), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op11_whitening"}))
def test_queries_return_each_document_once(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = QUERIES[name](spark, sf_dir)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    dirty = decontaminate.report(out, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0")
    assert dirty.isEmpty()
    shas = [hashlib.sha256(r.text.encode()).hexdigest() for r in out.select("text").collect()]
    assert len(shas) == len(set(shas))
