"""Corpus operators against the libraries and brute force, and on the odd rows."""

import math
import random
import re
import time
import tracemalloc
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from routeloom.llm import common, langid, licenses, linededup, mixing, neardup, packing, quality, queries, tokenfiles, tokens, transducer, vptree

DATA = "/root/testdata/sf0.001"
WORD, BYTE, PIECE = (common.vocabulary(n) for n in (queries.WORD_VOCABULARY, queries.BYTE_VOCABULARY, queries.PIECE_VOCABULARY))
ODD = [None, "", " ", "\n", "a", "The cat sat.", "The cat sat.", "x" * 3000, "né à İΣς ́ ½ 中文 😀", "<|endoftext|> a  <|endoftext|>", "don't we'll 'r 's'", "a\n\n b\t c\x0b", "w " * 2500]
SCHEMA = "doc_id long, text string, lang string, kept string, start string, salt string, k int, tie string, n_lines string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, a null doc_id, and columns named like those the operators make."""
    rows = [(i, t, None, "x", "y", "z", 1, "t", "n") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id here", "en", *rows[0][3:])], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


texts = st.text(alphabet=st.one_of(st.sampled_from(list("ab 'stREvl\n\t.,!?12éΣ中 <|")), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_are_the_library_s(text):
    for path in (WORD, BYTE):
        own = tokens.ids_of(path)
        want = own.tok.encode(text, add_special_tokens=False).ids
        assert list(array("I", own(text))) == want
    assert transducer.counter(WORD)(text) == len(tokens.ids_of(WORD).whole(text)) // 4


def test_chunks_compose():
    whole, cut = transducer.counter(WORD), transducer.Counter(WORD, chunk=5)
    for t in filter(None, ODD[:12]):
        assert cut(t) == whole(t) == len(Tokenizer.from_file(WORD).encode(t, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 9))
def test_state_maps_compose_at_any_place(text, chunk):
    own = transducer.counter(WORD)
    if any(s in text for s in own.specials) or tokens.doubtful().search(text):
        return
    low = tokens.lowered(text)
    maps = [own.chunk_map(low, i, min(len(low), i + chunk)) for i in range(0, len(low), chunk)]
    n = 0
    for k, m in enumerate(transducer.scan(maps), 1):
        after, n = m(own.start)
        assert n + own.finish(after) == own._count(low[: k * chunk])
    left = own.start
    for m in maps:  # one after another is the same
        left, _ = m(left)
    assert not maps or n + own.finish(after) == own._count(low)


def test_a_long_word_takes_little_memory():
    own = transducer.Counter(WORD, chunk=1024)
    text = "".join(random.Random(4).choice("abcde") for _ in range(400_000))
    tracemalloc.start()
    n = own(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(tokens.ids_of(WORD).whole(text)) // 4
    assert peak < 60e6  # with the heads of 400 chunks' prefixes it would be 80 MB and grow with the square


def test_token_counts(odd, none):
    rows = transducer.token_counts(odd, WORD).collect()
    assert len(rows) == len(ODD) + 2 and transducer.token_counts(none, WORD).count() == 0
    assert next(r for r in rows if r["doc_id"] == 12)["over_limit"] is True and next(r for r in rows if r["doc_id"] == 0)["n_bytes"] == 0


def brute_quality(text):
    w = re.findall(common.WORD, text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(windows)
    at = {i + j for i, x in enumerate(windows) if many[x] > 1 for j in range(5)}
    seen, double = set(), 0
    for line in (text or "").split("\n"):
        if re.search(common.WORD, line):
            double += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), double, len(at), len(w) < 10 or 100 * len(at) > 20 * len(w)


def test_quality(odd, none, real):
    for docs in (odd, real):
        texts_ = Counter((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
        got = quality.quality(docs, PIECE).collect()
        want = Counter({(k[0], *brute_quality(k[1])): 0 for k in texts_})
        for k, n in texts_.items():
            want[k[0], *brute_quality(k[1])] += n
        assert Counter(tuple(r[:7]) for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.quality(none, PIECE).count() == 0
    assert quality.keep_good(real, PIECE).count() == sum(r["kept"] for r in got)


def test_fertility_measures():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    text = "The quick brown fox 中文 jumps over the lazy dog again and again"
    ids = Counter(i for w in text.split() for i in model.encode(w))
    n = sum(ids.values())
    got = quality.judge(text, quality.fertility(PIECE))
    assert got[7] == n and got[8] == "LATIN"
    assert got[10] == pytest.approx(sum(map(str.isalpha, text)) / n)
    assert got[11] == pytest.approx(sum(c for i, c in ids.items() if model.is_byte(i)) / n)
    assert got[12] == pytest.approx(-sum(c / n * np.log2(c / n) for c in ids.values()))
    assert quality.judge("q1Zx9Kk " * 3 + "kW8 jjZ2 0xPq zzKv 7yTr bN5c Lm3X " * 4, quality.fertility(PIECE))[6] is False


def test_licenses(spark, none):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(0, "start here. " + mit.replace("free of charge", "gratis") + " the end"), (1, "nothing of the sort " * 50), (2, None), (3, "Some words.\nReleased under the MIT License.\nMore words. Released under the MIT License."), (4, "the license software copy " * 40), (5, "noise\n" + mit.upper())]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["license"] == "MIT" and 0.95 < got[0]["coverage"] < 1 and got[5]["coverage"] == 1
    assert [got[i]["license"] for i in (1, 2, 4)] == [None] * 3 and got[3]["license"] == "MIT line"
    assert licenses.scan(none).count() == 0


def test_licenses_are_told_apart(spark):
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    want = {
        "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the BSD License.": "BSD",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        gnu.format("General Public License", 2): "GPL-2.0-or-later",
        gnu.format("General Public License", 3): "GPL-3.0-or-later",
        gnu.format("Lesser General Public License", "2.1"): "LGPL-2.1-or-later",
        gnu.format("Affero General Public License", 3): "AGPL-3.0-or-later",
        licenses.TEMPLATES["BSD-3-Clause"].replace("copyright holder", "Regents"): "BSD-3-Clause",
        licenses.TEMPLATES["BSD-2-Clause"]: "BSD-2-Clause",
        licenses.TEMPLATES["ISC"]: "ISC",
        **{f"Copyright someone. {t} And more.": k.split(" ")[0] for k, t in licenses.TEXTS.items()},
    }
    rows = [(i, f"Some words before. {t} Some after.") for i, t in enumerate(want)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license"].split(" ")[0] for i in range(len(rows))] == list(want.values())
    assert all({x.split(" ")[0] for x in got[i]["licenses"]} == {k} for i, k in enumerate(want.values()) if i < 13)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=14))
def test_alignment_is_a_common_subsequence(a, b):
    got = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0], row
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(12)), st.lists(st.integers(0, 30), unique=True, max_size=20), st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=14))
def test_alignment_against_brute_force(template, text, a, b):
    """Of words that are unique in both all that can be aligned are; of others never more than can."""
    assert len(licenses.align(text, list(template))) == common_length(text, list(template))
    assert len(licenses.align(a, b)) <= common_length(a, b)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 400), st.lists(st.integers(0, 9), min_size=30, max_size=30), st.sets(st.integers(0, 29), max_size=6))
def test_best_window_against_brute_force(before, fillers, lost):
    """A template with words left out and others between them, anywhere in a longer text: its coverage is that of the whole text."""
    template = [f"t{i}" for i in range(30)]
    text = [f"x{i % 7}" for i in range(before)]
    for i, w in enumerate(template):
        text += [f"f{i}-{k}" for k in range(fillers[i] % (2 * licenses.SPAN - 1))] + [w] * (i not in lost)
    text += [f"y{i % 5}" for i in range(before // 2)]
    span = [i for i, w in enumerate(text) if w in template]
    if span[-1] - span[0] < licenses.SPAN * len(template):
        assert len(licenses.best(text, template, 0.8)) == common_length(text, template) == 30 - len(lost)


def test_licenses_with_words_between(spark, odd):
    mit = licenses.words(licenses.TEMPLATES["MIT"])
    text = " ".join(w for x in mit for w in (x.decode(), "foo", "bar"))
    rows = [(1, f"{'and so on ' * 3000} {text} {'the end ' * 3000}", "x"), (None, text, "y")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert [(r["license"], r["coverage"], r["n_aligned"]) for r in got] == [("MIT", 1.0, len(mit))] * 2
    assert licenses.scan(odd).count() == len(ODD) + 2


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan(histogram):
    slots = Counter()
    bins: dict[int, list] = {}
    runs = sorted(packing.plan(histogram, 32))
    for length, n in histogram.items():
        own = [r for r in runs if r[0] == length]
        for rank in range(n):
            r = [x for x in own if x[1] <= rank][-1]
            j = rank - r[1]
            bins.setdefault(r[2] + j // r[3], []).append((r[4] + j % r[3] * length, length))
            slots[length] += 1
    assert slots == Counter(histogram)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 32
    tight = sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True)
    rooms: list[int] = []
    for x in tight:  # best fit, one piece after another
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms[rooms.index(min(fit))] -= x
        else:
            rooms.append(32 - x)
    assert len(bins) == len(rooms)


def test_packing(odd, none, real):
    tok = Tokenizer.from_file(WORD)
    for docs in (odd, real):
        got = packing.best_fit(docs, WORD).collect()
        by: dict = {}
        for r in got:
            by.setdefault(r["sequence_id"], []).append(r)
        for rows in by.values():
            at = 0
            for r in sorted(rows, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 2048
        want = Counter()
        for d in docs.select("doc_id", "text").collect():
            ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 0]
            for p, i in enumerate(range(0, len(ids), 2048)):
                want[d["doc_id"], p, i, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())] += 1
        assert Counter(tuple(r[:5]) for r in got) == want
        assert len(by) <= 1.05 * sum(r["length"] for r in got) / 2048 + 2
    assert packing.best_fit(none, WORD).count() == 0


def test_token_files(spark, odd, none, real, tmp_path):
    tok = Tokenizer.from_file(BYTE)
    files = tokenfiles.write_tokens(real, BYTE, f"file://{tmp_path}/t")
    got = tokenfiles.read_tokens(spark, files).collect()
    start = 0
    for d, r in zip(real.orderBy("doc_id").collect(), sorted(got, key=lambda r: r["doc_id"]), strict=True):
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = {r["doc_id"]: r for r in tokenfiles.read_tokens(spark, files, {3, 70}).collect()}
    assert some == {r["doc_id"]: r for r in got if r["doc_id"] in (3, 70)}
    assert tokenfiles.token_files(odd, BYTE).count() == len(ODD) + 2
    assert tokenfiles.token_files(none, BYTE).count() == 0


def test_token_file_frames(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FRAME", 64)
    docs = [(None, b"\1\0\0\0"), (2, bytes(400)), (5, b""), (5, b"\2\0\0\0" * 9)]
    w = tokenfiles.Writer(f"{tmp_path}/x/a.tok")
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    r = tokenfiles.Reader(f"{tmp_path}/x/a.tok")
    assert [(d, ids) for d, _, ids in r.rows()] == docs and [d for d, _, _ in r.rows({5})] == [5, 5]
    raw = bytearray((tmp_path / "x/a.tok").read_bytes())
    raw[8] ^= 1
    (tmp_path / "x/b.tok").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017  zstandard's own error, or ours
        list(tokenfiles.Reader(f"{tmp_path}/x/b.tok").rows())


def test_line_dedup(spark, odd, none):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"a b c\n{long}\nend one"), (2, f"{long}\nother text"), (3, long), (4, "short\nshort\nshort"), (5, None), (5, None), (None, f"x\n{long}"), (6, f"{long}\nq\n{long}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in linededup.dedup_lines(docs).collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (2, "other text"), (3, ""), (4, "short\nshort\nshort"), (5, None), (5, None), (None, "x"), (6, "q")], key=str)
    assert linededup.dedup_lines(odd).count() == len(ODD) + 2 and linededup.dedup_lines(none).count() == 0
    assert set(odd.columns) <= set(linededup.dedup_lines(odd).columns)


def test_repeated_passages_of_several_lines(spark):
    """Planted between differing lines, passages of 2 to 8 lines go from the later document whole, and nothing else goes."""
    r, rows, want = random.Random(5), [], {}
    line = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    shapes = [(3, 20), (4, 25), (2, 45), (6, 10), (8, 15), (1, 55)] * 4
    for k, (n, words) in enumerate(shapes):
        passage, own = "\n".join(line(words) for _ in range(n)), [[line(r.choice([4, 30])) for _ in range(r.choice([1, 3]))] for _ in range(4)]
        rows += [(2 * k, "\n".join([*own[0], passage, *own[1]])), (2 * k + 1, "\n".join([*own[2], passage, *own[3]]))]
        want |= {2 * k: rows[-2][1], 2 * k + 1: "\n".join(own[2] + own[3])}
    chinese = "\n".join("".join(chr(0x4E00 + r.randrange(9000)) for _ in range(300)) for _ in range(2))
    tabs = "\n".join("\t".join(line(30).split()) for _ in range(2))
    for k, p in ((100, chinese), (102, tabs)):
        rows += [(k, f"one\n{p}\ntwo"), (k + 1, f"three\n{p}\nfour")]
        want |= {k: rows[-2][1], k + 1: "three\nfour"}
    got = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_line_dedup_keeps_columns_with_its_own_names(spark):
    names = "lines ends left_lines row_order gone marks doc tie whole key a b i x h w c s m r kept rest runs passage place found first".split()
    docs = spark.createDataFrame([(1, "one\ntwo", *names), (2, "one\ntwo", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = linededup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed_lines", "n_removed_runs"]
    assert sorted(tuple(x)[:-3] for x in got.collect()) == sorted(map(tuple, docs.collect()))


def test_line_dedup_of_many_lines(spark):
    """The time follows the number of lines, also behind a filter on the text."""
    import corpus_pipeline

    text = "\n".join(f"line {i} " + "with some words " * 3 for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, text + "\nand more")], "doc_id long, text string")
    began = time.perf_counter()
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.without_repeated_lines(spark, docs, DATA).collect()}
    assert got == {1: text, 2: "and more"} and time.perf_counter() - began < 60


def brute_groups(docs):
    sets = {}
    for i, t in docs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(common.WORD, t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for k, b in enumerate(ids) for a in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates(spark, odd, none):
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for g in range(30):
        base = [r.choice(words) for _ in range(r.choice([6, 30, 120]))]
        for _ in range(140 if g == 0 else r.choice([1, 2, 5])):
            w = list(base)
            for _ in range(r.choice([0, 1, 3])):
                w[r.randrange(len(w))] = r.choice(words)
            docs.append(" ".join(w))
    docs += ["one two", "ONE two", "", None, "a b c d e", "a b c d e"]
    rows = [*enumerate(docs)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_groups(rows)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    assert neardup.near_duplicates(odd).count() == len(ODD) + 2 and neardup.near_duplicates(none).count() == 0
    assert neardup.keep_firsts(odd).columns == odd.columns


def test_links_in_a_crowd(spark):
    """Texts that are alike at 0.74 and not linked, among them pairs at 0.78: every link is found."""
    same = [f"t{i}" for i in range(140)]
    docs = [same + [f"p{i % 600}-{j}" if i % 600 < 100 and j < 4 else f"u{i}-{j}" for j in range(24)] for i in range(1200)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    column: dict = {}
    has = np.zeros((1200, 30000), np.float32)
    for i, w in enumerate(docs):
        for k in range(len(w) - 4):
            has[i, column.setdefault(tuple(w[k : k + 5]), len(column))] = 1
    both = has @ has.T
    links = np.argwhere(np.triu(100 * both >= 75 * (320 - both), 1)).tolist()  # 160 shingles each
    assert links == [[i, i + 600] for i in range(100)]
    first = {b: a for a, b in links}
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == {i: (160, first.get(i, i)) for i in range(1200)}


def brute_mix(docs, labels, targets, growth, anchor):
    """Posteriors and rates in numpy, from the rows that the operator learns from."""
    domains = sorted(targets)
    words = lambda t: {mixing_bucket(w) for w in re.findall(common.WORD, t or "")}
    fold = {r["doc_id"]: r["held"] for r in labels.select("doc_id", (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(mixing.HELD)) == 0).alias("held")).collect()}
    known = [(r["doc_id"], words(r["text"]), domains.index(r["domain"])) for r in labels.collect()]
    counts, prior = np.full((len(domains), mixing.BUCKETS), 0.5), np.ones(len(domains))
    for i, w, k in known:
        if not fold[i]:
            counts[k, list(w)] += 1
            prior[k] += 1
    logs, prior = np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(prior / prior.sum())

    def softmax(w, power, scale):
        z = prior + logs[:, list(w)].sum(axis=1) * scale / max(1, len(w)) ** power
        z = np.exp(z - z.max())
        return z / z.sum()

    held = [(w, k) for i, w, k in known if fold[i] and w]
    power, scale = min(((p, s) for p in mixing.POWERS for s in mixing.SCALES), key=lambda c: -sum(math.log(max(softmax(w, *c)[k], 1e-300)) for w, k in held))
    p = np.array([softmax(words(t), power, scale) for _, t in docs])
    n = np.array([len(re.findall(r"[^\W\d_]+|\d|[^\s\w]+|_+", t or "")) for _, t in docs], float)
    cell = np.floor(p * mixing.GRID + 0.5)
    least = np.where(cell.argmax(axis=1) == (domains.index(anchor) if anchor else -1), 1.0, 0.0)
    target, at, total = np.array([targets[d] for d in domains]), cell / mixing.GRID, n.sum()
    rate, best, since = np.full(len(docs), float(growth)), (np.inf, None), 0
    for step in range(61):
        off = (rate * n) @ p / (growth * total) - target
        if (now := np.abs(off).max()) < 0.98 * best[0] or step < 3:
            best, since = ((now, rate), 0) if now < best[0] else (best, since)
        else:
            since += 1
        if best[0] < 1e-6 or since == 5:
            break
        free = (rate > least)[:, None]
        rate = np.maximum(least, rate - at @ (np.linalg.pinv((p * n[:, None] * free).T @ at / (growth * total), rcond=1e-9) @ off))
    rate = best[1]
    return p, n, rate


def test_mixing(spark, none, real):
    labels = mixing.labelled_documents(real, spark.read.parquet(f"{DATA}/labels.parquet"))
    buckets = {r["w"]: r["b"] for r in real.select(F.explode(mixing.words_of(F.col("text"))).alias("w")).distinct().select("w", mixing.bucket(F.col("w")).alias("b")).collect()}
    globals()["mixing_bucket"] = buckets.__getitem__
    targets = {"high": 0.8, "low": 0.12, "toxic": 0.08}
    rows = mixing.mix(real, labels, targets, 1.2, "high").toPandas().sort_values("doc_id")
    docs = sorted((r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect())
    p, n, rate = brute_mix(docs, labels, targets, 1.2, "high")
    assert np.allclose(np.stack(rows["p"]), p, atol=1e-9) and (rows["n_tokens"] == n).all()
    assert np.allclose(rows["rate"], rate, atol=1e-6)
    share = (rate * n) @ p / (1.2 * n.sum())
    assert np.abs(share - [0.8, 0.12, 0.08]).max() == pytest.approx(rows["residual"].iloc[0], abs=1e-6)
    assert ((rows["copies"] - rows["rate"]).abs() < 1).all()
    assert (rows["copies"][p.argmax(axis=1) == 0] >= 1).all()  # none of the anchor's is lost
    assert (p.max(axis=1) < 0.99).mean() > 0.5  # membership is soft
    assert mixing.mix(none, mixing.labelled_documents(none, none.selectExpr("doc_id", "k quality", "k toxic")), mixing.TARGETS).count() == 0


def test_mixing_far_from_the_corpus(spark):
    """The registered targets: many rates are cut at zero, and rates and residual are those of brute force."""
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = mixing.labelled_documents(docs_, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    buckets = {r["w"]: r["b"] for r in docs_.select(F.explode(mixing.words_of(F.col("text"))).alias("w")).distinct().select("w", mixing.bucket(F.col("w")).alias("b")).collect()}
    globals()["mixing_bucket"] = buckets.__getitem__
    texts_ = [tuple(r) for r in docs_.select("doc_id", "text").orderBy("doc_id").collect()]
    for targets, cut in ((mixing.TARGETS, 0.0), ({"high": 0.1, "low": 0.6, "toxic": 0.3}, 0.1)):
        far = mixing.mix(docs_, labels, targets, mixing.GROWTH).orderBy("doc_id").toPandas()
        p, n, rate = brute_mix(texts_, labels, targets, mixing.GROWTH, None)
        want = np.array([targets[d] for d in sorted(targets)])
        assert np.abs(n @ p / n.sum() - want).max() > 0.2
        assert np.allclose(far["rate"], rate, atol=1e-6) and (rate == 0).mean() >= cut and (rate >= 0).all()
        assert far["residual"].iloc[0] == pytest.approx(np.abs((rate * n) @ p / n.sum() - want).max(), abs=1e-6) and far["residual"].iloc[0] < 0.01


def test_mixed_rows(spark, odd, none, real):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    names = "copies copy p cell rate whole z odds scores buckets n_tokens row_tie key_id residual".split()
    docs = real.select("*", *[F.lit(n).alias(n) for n in names])
    got = mixing.mixed(docs, labels)
    assert got.columns == docs.columns and got.where(" or ".join(f"{n} <> '{n}'" for n in names)).count() == 0
    want = mixing.mix(real, mixing.labelled_documents(real, labels), mixing.KEPT_TARGETS, mixing.KEPT_GROWTH, mixing.ANCHOR).select("doc_id", "copies").collect()
    assert Counter(r["doc_id"] for r in got.select("doc_id").collect()) == Counter({r["doc_id"]: r["copies"] for r in want if r["copies"]})
    assert mixing.mixed(none, labels).count() == 0 and mixing.mixed(odd, labels.limit(0)).count() >= len(ODD)
    assert mixing.mixed(odd, labels).columns == odd.columns


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    test = got[got["held_out"] & got["lang"].notna()]
    assert (test["lang"] == test["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    rows = {r["doc_id"]: r for r in langid.predict(odd, langid.learn(docs)).collect()}
    assert [rows[i]["lang_pred"] for i in range(4)] == ["und"] * 4
    assert langid.predict(odd, langid.learn(none)).where("lang_pred <> 'und'").count() == 0 and langid.predict(none, langid.learn(docs)).count() == 0


def test_language_against_brute_force(spark):
    """Plain-Python naive Bayes over the same n-grams."""

    def grams(text):
        s = [ord(c) if ord(c) >= 128 or "a" <= c <= "z" else 32 for c in f"  {text.lower()}  "]
        for i in range(len(s)):
            h = 0
            for n in range(min(3, len(s) - i)):
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ s[i + n]
                yield ((h + n & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> 17

    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choice(a) for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(1, 12))), k) for i in range(150) for k, a in [r.choice([("aa", "abcdeé"), ("bb", "cdefgh1"), ("cc", "中文字a")])]]
    train = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5]
    counts = {k: Counter() for k in ("aa", "bb", "cc")}
    for _, t, k in train:
        counts[k].update(grams(t))
    sums = {k: sum(c.values()) + langid.BUCKETS for k, c in counts.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(docs.drop("lang"), langid.learn(docs)).collect()}
    for i, t, _ in rows:
        if any(map(str.isalpha, t)):
            z = {k: sum(math.log((c[g] + 1) / sums[k]) for g in grams(t)) for k, c in counts.items()}
            top = max(z, key=z.get)
            assert got[i] == (top, pytest.approx(1 / sum(math.exp(v - z[top]) for v in z.values()), abs=1e-4))
        else:
            assert got[i] == ("und", 0.0)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60), st.integers(3, 20))
def test_language_pieces_lose_no_ngram(text, piece):
    whole = Counter(np.concatenate([*map(langid.buckets, langid.cut(text))]).tolist())
    old, langid.PIECE = langid.PIECE, piece
    try:
        assert Counter(np.concatenate([*map(langid.buckets, langid.cut(text))]).tolist()) == whole
    finally:
        langid.PIECE = old


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 12)).astype(np.float32) * rng.uniform(0.2, 3, size=(700, 1)).astype(np.float32)
    x[40:90] = x[40]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [0.0] * 12, 1), (1040, [float("nan")] * 12, 1), (1060, [1.0, None], 1), (20, rows[20][1], 1)]
    got = vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).toPandas()
    d = x.astype(np.float64)
    for q in range(0, 700, 20):
        s = (d * d[q]).sum(axis=1)
        want = [i for i in sorted(range(700), key=lambda i: (-s[i], i)) if i != q][:20]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["vec_id"].tolist() == want and np.allclose(own["score"], s[want])
    assert set(got["query_id"]) == set(range(0, 700, 20))


def brute_nearest(x, k=20):
    d = np.asarray(x, np.float64)
    out = {}
    for q in range(0, len(d), 20):
        s = (d * d[q]).sum(axis=1)
        out[q] = [(i, s[i]) for i in sorted(range(len(d)), key=lambda i: (-s[i], i)) if i != q][:k]
    return out


@pytest.mark.parametrize("kind", ["ties", "large norms", "clusters", "mixed norms"])
def test_nearest_over_shards(spark, kind):
    """Several shards and blocks: distinct vectors of equal products, large and mixed norms, cells that are left out."""
    rng = np.random.default_rng(3)
    x = {
        "ties": lambda: rng.integers(-1, 2, size=(1500, 8)).astype(float) + np.eye(8)[0] * 2,
        "large norms": lambda: rng.normal(size=(1500, 8)) * 1e4 + 3e4,
        "clusters": lambda: rng.normal(size=(1500, 8)) * 0.01 + rng.normal(size=(10, 8))[rng.integers(0, 10, 1500)],
        "mixed norms": lambda: rng.normal(size=(1500, 8)) * 10.0 ** rng.integers(-3, 4, size=(1500, 1)),
    }[kind]()
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vptree.nearest(docs, shard=100).toPandas().sort_values(["query_id", "rank"])
    want = brute_nearest(x)
    assert {q: list(zip(g["vec_id"], g["score"], strict=True)) for q, g in got.groupby("query_id")} == want
    loose = vptree.nearest(docs, shard=100, factor=1.2).toPandas()  # leaves out more; what it finds has its true score
    d = np.asarray(x, np.float64)
    assert all(r.score == (d[r.query_id] * d[r.vec_id]).sum() for r in loose.itertuples())
    hits = sum(len({i for i, _ in want[q]} & set(g["vec_id"])) for q, g in loose.groupby("query_id"))
    assert hits >= 0.7 * sum(map(len, want.values()))


def test_nearest_of_few(spark):
    of = lambda rows: sorted(map(tuple, vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, tie int, cell string")).collect()))
    assert of([]) == [] and of([(20, [1.0], 1, "c")]) == []
    assert of([(20, [1.0, 0.0], 1, "c"), (1, [2.0, 0.0], 1, "c"), (2, [9.0], 1, "c"), (40, [3.0], 1, "c")]) == [(20, 1, 1, 2.0), (40, 1, 2, 27.0)]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.stored(stage(spark, kept, DATA))
        assert kept.columns == docs.columns and 0 < kept.count() <= 2 * docs.count()
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.agg(F.sum("length")).first()[0] == packing.pieces(kept, WORD).agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("kind", ["documents", "few lines", "blanks"])
def test_line_dedup_matches_duckdb(spark, kind):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    if kind == "documents":
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    else:
        r = random.Random(9)
        lines = [" ".join(f"{k}{i}" for i in range(n)) for k, n in zip("abcdefghij", (1, 3, 8, 12, 20, 26, 40, 49, 50, 70), strict=True)] + ["", " \t"] * (kind == "blanks")
        documents = pd.DataFrame([(i, "\n".join(r.choice(lines) for _ in range(r.choice([0, 1, 2, 5, 12])))) for i in range(120)], columns=["doc_id", "text"])
        docs = spark.createDataFrame(documents)
        con.register("documents", documents)
    want = con.sql(queries.OP6_SQL).df()
    got = queries.digest(linededup.dedup_lines(docs.select("doc_id", "text"))).toPandas()
    assert sorted(map(repr, got[sorted(got)].values.tolist())) == sorted(map(repr, want[sorted(want)].values.tolist()))


def test_stages_on_odd_rows(spark, odd, none):
    """Nulls, empties, repeated rows, no rows and columns of any name go through every stage."""
    import corpus_pipeline

    names = "class id component kept signature copies p cell whole lines gone doc tie spans n_lines piece length salt rank".split()
    more = odd.select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    for docs in (more, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, DATA)
            assert got.columns == docs.columns
            rows = got.collect()
            assert all(r[n] == n for r in rows for n in names if n in docs.columns and n != "n_lines" and docs is more)
            assert docs is more or not rows
        assert corpus_pipeline.packed(spark, docs, DATA).count() == sum(x["length"] > 0 for x in packing.pieces(docs, WORD).collect())


def test_very_long_texts(spark):
    """Texts of a few megabytes, with and without white space, and beside them a short one."""
    r = random.Random(8)
    words = [f"word{i}" for i in range(5000)]
    prose = "\n".join(" ".join(r.choice(words) for _ in range(20)) for _ in range(10_000))
    docs = spark.createDataFrame([(1, prose, "en"), (2, prose + " end", "en"), (3, "x" * 1_000_000, None), (4, "short text", "en")], "doc_id long, text string, lang string")
    by = lambda rows: {x["doc_id"]: x for x in rows.collect()}
    assert by(quality.quality(docs, PIECE))[1]["n_words"] == 200_000
    n = by(transducer.token_counts(docs, WORD))
    packed = Counter()
    for x in packing.best_fit(docs, WORD).collect():
        packed[x["doc_id"]] += x["length"]
    assert packed == {i: n[i]["n_tokens"] + 1 for i in n}
    assert by(licenses.scan(docs))[2]["n_words"] == 200_001
    assert {i: x["n_removed_lines"] for i, x in by(linededup.dedup_lines(docs)).items()} == {1: 0, 2: 9_999, 3: 0, 4: 0}
    assert {i: x["component_id"] for i, x in by(neardup.near_duplicates(docs)).items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert by(langid.predict(docs, langid.learn(docs)))[1]["lang_pred"] == "en"
    assert by(tokenfiles.token_files(docs, BYTE))[2]["n_tokens"] > 200_000


def test_rare_characters_are_one_quick_class():
    found = {c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if tokens.rare().match(c)}
    assert found == {c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if c >= "\U00010000" or c in tokens.SPACES and not c.isascii() or tokens.doubtful().match(c)}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_texts_of_odd_spaces(name):
    rng, path = random.Random(7), common.vocabulary(name)
    own, lib = tokens.ids_of(path), Tokenizer.from_file(path)
    signs = [*" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0", "\u2009", "\u3000", *"aZ1!", "'s", "é", "Σ", "中", "\u0301", "\U0001d54f", "\U0001f600"]
    for text in ["".join(rng.choices(signs, k=rng.randrange(1, 12))) for _ in range(2000)]:
        assert own(text) == array("I", lib.encode(text, add_special_tokens=False).ids).tobytes()
