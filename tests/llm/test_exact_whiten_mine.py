"""Exact groups, whitening and hard negatives: SQL, brute force, odd rows, hot groups, restarts."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import exactdedup, hardnegatives, queries, whitening

SPACE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


@pytest.mark.parametrize("name", ["op11_exact_groups", "op13_hard_negatives"])
def test_matches_duckdb(spark, name):
    folder, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 200
    columns = sorted(want.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


# --- exact groups


def brute_groups(rows):
    """Counter of (doc_id, keep_id, group_size, kept, sha); of rows equal in doc_id and length one stays."""
    by = defaultdict(list)
    for i, t in rows:
        by[(t or "").translate(SPACE)].append((i, len(t or "")))
    out = Counter()
    for body, own in by.items():
        sha = hashlib.sha256(body.encode()).hexdigest()
        first = min(own, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        left = list(own)
        left.remove(first)
        out[first[0], first[0], len(own), True, sha] += 1
        for i, _ in left:
            out[i, first[0], len(own), False, sha] += 1
    return out


def odd_texts():
    long = "é " * 40_000
    texts = [None, "", " \t\n\x0b\x0c\r", "a b", "ab", "a\nb ", "A b", "a b", "a\x1fb", "\x85ab", long, long.strip(), "é" * 40_000, "中文", "中 文", "😀 a", "😀a"]
    rows = list(enumerate(texts)) + [(3, "a b"), (3, "a b"), (3, "ab "), (None, "a b c"), (None, "abc"), (None, "x  y"), (7, "xy"), (-5, "x y "), (9, "n o"), (None, "n o")]
    return [*rows, *((100 + i, "a  lot of copies" + " " * (i % 7)) for i in range(500))]


@pytest.mark.parametrize("digest", [exactdedup.DIGEST, 1])
def test_odd_texts_and_clashing_digests(spark, digest):
    """With one byte of digest hundreds of texts share keys; their bytes tell them apart."""
    rows = odd_texts() + ([(1000 + i, f"text {i % 400}") for i in range(900)] if digest == 1 else [])
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, n int").repartition(5)
    got = exactdedup.deduplicate(docs, digest=digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_groups(rows)


def test_no_documents(spark):
    assert exactdedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_state_goes_on(spark, tmp_path):
    """Files that arrive later meet the state of an earlier run; small micro-batches give what one gives."""
    r = random.Random(2)
    rows = [(i, f"text {r.randrange(60)}" + " " * r.randrange(3)) for i in range(300)]
    path, checkpoint = f"file://{tmp_path}/docs", f"file://{tmp_path}/state"
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    frame(rows[:120]).repartition(3).write.parquet(path)
    first = exactdedup.groups(spark, path, checkpoint, batch=1)
    assert Counter(map(tuple, first.collect())) == brute_groups(rows[:120])
    state = {bytes(r["digest"]): r["n"] for r in exactdedup.held(spark, checkpoint).collect()}
    assert sum(state.values()) == 120
    frame(rows[120:]).repartition(2).write.mode("append").parquet(path)
    again = exactdedup.groups(spark, path, checkpoint, batch=1)
    assert Counter(map(tuple, again.collect())) == brute_groups(rows)
    kept = {r["digest"]: r for r in exactdedup.held(spark, checkpoint).collect()}
    assert sum(r["n"] for r in kept.values()) == 300 and all(r["best"]["file"].startswith("file:") for r in kept.values())


def test_files_that_changed_are_refused(spark, tmp_path):
    path, checkpoint = f"file://{tmp_path}/docs", f"file://{tmp_path}/state"
    one = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string").coalesce(1)
    one.write.parquet(path)
    exactdedup.groups(spark, path, checkpoint)
    one.where("doc_id = 1").write.mode("overwrite").parquet(path)
    exactdedup.observe(spark, path, exactdedup.schema_of(one), checkpoint)
    one.limit(0).write.mode("overwrite").parquet(path)
    with pytest.raises(Exception, match="not those of the state"):
        exactdedup.groups(spark, path, checkpoint).collect()


# --- whitening


def brute_whitened(rows, k=16):
    """(n, deviations, whitened up to sign, eigenvalues, trace) in numpy."""
    x = np.floor(64 * np.array(rows, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    own = len(u) * x - u.sum(axis=0)
    c = (u - u.sum(axis=0) / len(u)).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / len(u))
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(k, int((values > 1e-12 * values[0]).sum()))
    w = own / len(u) @ vectors[:, :keep] / np.sqrt(values[:keep])
    return len(u), (own.astype(object) ** 2).sum(axis=1), w, values, values.sum()


@pytest.mark.parametrize("kind", ["plain", "few", "repeated", "flat"])
def test_whitening_against_numpy(spark, kind):
    r = np.random.default_rng(3)
    spread = np.geomspace(1, 0.02, 24)
    x = r.standard_normal((400, 24)) * spread
    if kind == "few":
        x = x[:9]
    elif kind == "repeated":  # a third of the rows are one vector
        x[::3] = x[0]
    elif kind == "flat":  # variance in four dimensions only
        x[:, 4:] = 0.5
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)).toPandas()
    n, deviation, want, values, trace = brute_whitened(x.tolist())
    k = want.shape[1]
    assert k == {"few": 8, "flat": 4}.get(kind, 16) and len(got) == len(x) * k and set(got["n"]) == {n}
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    w = w * np.sign((w * want).sum(axis=0))
    assert np.allclose(w, want, atol=1e-8)
    assert got.drop_duplicates("vec_id").sort_values("vec_id")["deviation"].tolist() == deviation.tolist()
    assert np.allclose(got.drop_duplicates("component").sort_values("component")["explained"], values[:k] / trace, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 0.5]), (2, [2.0, 0.5]), (None, [0.0, -1.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [3.0]), (10, [1e300, 0.0]), (11, [1.0, 2.0, 3.0]), (12, [0.0, 0.0, 1.0])]
    frame = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n string")
    got = Counter(r["vec_id"] for r in whitening.whiten(frame(rows)).collect())
    assert got == {1: 2, 2: 4, None: 2, 11: 1, 12: 1}  # 9 is alone of its length
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame([(1, [1.0]), (2, [1.0])])).count() == 0
    far = whitening.whiten(frame([(1, [float(1 << 45)]), (2, [0.0]), (3, [1.0])])).toPandas()
    assert far["deviation"].isna().any() and far["identity_error"].iloc[0] < 1e-6


def dense(a):
    return lambda q: a @ q


def test_lanczos_restarts_and_converges():
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.standard_normal((200, 200)))[0]
    # equal eigenvalues, more than a block has columns: the space ends early, all of them are found
    values = np.repeat([5.0, 3.0, 1.0, 0.5], [12, 50, 38, 100])
    for k, block in ((20, 1), (13, 16), (12, 12)):
        got, vectors, passes = whitening.lanczos(dense(q @ np.diag(values) @ q.T), 200, k, block)
        assert np.allclose(got, values[:k], rtol=1e-13) and passes * max(block, k) <= 200 and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    # three directions only: blocks break down and go on with random ones
    got, vectors, passes = whitening.lanczos(dense(q[:, :3] @ q[:, :3].T), 200, 8, 8)
    assert np.allclose(got, [1, 1, 1, 0, 0, 0, 0, 0], atol=1e-13) and np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)
    # a falling spectrum needs a part of the space only
    values = 0.7 ** np.arange(200)
    a = q @ np.diag(values) @ q.T
    got, vectors, passes = whitening.lanczos(dense(a), 200, 8, 8)
    assert np.allclose(got, values[:8], rtol=1e-12) and passes * 8 < 120
    assert np.abs(np.abs(vectors.T @ q[:, :8]) - np.eye(8)).max() < 1e-9
    got, vectors, passes = whitening.lanczos(dense(np.zeros((5, 5))), 5, 3, 2)
    assert (got == 0).all() and vectors.shape == (5, 3)


def test_orthogonal_replaces_what_is_not_new():
    rng = np.random.default_rng(0)
    basis = np.eye(6)[:, :3]
    out = whitening.orthogonal(np.hstack([basis[:, :2], np.ones((6, 2))]), basis, 1e-13, rng)
    assert out.shape == (6, 3) and np.allclose(np.hstack([basis, out]).T @ np.hstack([basis, out]), np.eye(6), atol=1e-14)


# --- hard negatives


def brute_mined(rows, every=100, positives=5, negatives=10, low=30, high=90):
    rows = list(dict.fromkeys((i, y, tuple(int(np.floor(256 * c)) for c in v)) for i, v, y in rows if i is not None and v is not None and y is not None and all(c is not None and np.isfinite(c) for c in v)))
    out, dot = Counter(), lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    for a in rows:
        if a[0] % every:
            continue
        others = sorted((-dot(a[2], b[2]), b[0], b[1]) for b in rows if b is not a and len(b[2]) == len(a[2]))
        for s, i, _ in [o for o in others if o[2] == a[1]][:positives]:
            found = [o for o in others if o[2] != a[1] and low * -s <= 100 * -o[0] <= high * -s]
            out.update((a[0], i, k + 1, o[1], -s, -o[0]) for k, o in enumerate(found[:negatives]))
    return out


@pytest.mark.parametrize("kind", ["plain", "tied", "hot", "wide"])
@pytest.mark.parametrize("few", [hardnegatives.FEW, 1])
def test_mining_against_brute_force(spark, monkeypatch, kind, few):
    """`few` = 1 refines every bucket to the last digit; ties and hot vectors go on by vec_id; several blocks."""
    monkeypatch.setattr(hardnegatives, "FEW", few)
    r = np.random.default_rng(8)
    x = r.standard_normal((700, 6)) * (0.3 if kind != "wide" else 3000)
    if kind == "tied":
        x = np.round(x * 3) / 4
    ids, labels = np.arange(-50, 650) * (1 if kind != "wide" else 10**12), r.integers(0, 4, 700)
    if kind == "hot":
        x[::2], labels[::2] = x[0], np.where(np.arange(350) % 2, 1, 2)
    rows = list(zip(ids.tolist(), x.tolist(), labels.tolist(), strict=True))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = Counter(map(tuple, hardnegatives.mine(docs, every=20 if kind != "wide" else 20 * 10**12, block=16).collect()))
    want = brute_mined(rows, every=20 if kind != "wide" else 20 * 10**12)
    assert got == want and len(want) > 500


def test_mining_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.9], 1), (1, [0.9, 1.0], 2), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2), (3, [0.5, 0.6], None), (4, None, 2), (None, [0.5, 0.5], 2), (5, [nan, 1.0], 2), (6, [0.1, None], 2), (7, [1.0], 2), (100, [1.0], 3), (200, [-1.0, -1.0], 5), (201, [1.0, 1.0], 5), (300, [], 1), (301, [], 2), (400, [0.0, 0.0], 9), (401, [0.0, 1.0], 9), (8, [1e9, 0.0], 2)]
    frame = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, rank string, dim int")
    got = Counter(map(tuple, hardnegatives.mine(frame(rows)).collect()))
    assert got == brute_mined([r for r in rows if r[0] != 8]) and sum(got.values()) > 3
    assert hardnegatives.mine(frame([])).count() == 0 and hardnegatives.mine(frame(rows).where("vec_id % 100 <> 0")).count() == 0
