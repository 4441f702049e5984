"""Negatives of one performer and one language: single use, maximality, and equality with taking keys one by one."""

import hashlib

import numpy as np

from tracefold.operators import sampling


def h(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def one_by_one(rows, key, seed, used):
    """Keys by precedence, each taking its two best free works."""
    by = {}
    for p, performer, title, instrumental, language in rows:
        k = performer if key == "performer" else language
        if k and not instrumental and title.strip():
            by.setdefault(k, {}).setdefault(title, []).append(p)
    out = {}
    for k in sorted(by, key=lambda k: (h(seed, k), k)):
        free = sorted((t for t in by[k] if t not in used), key=lambda t: (h(seed, k, t), t))
        if len(free) >= 2:
            out[k] = tuple((t, min(by[k][t], key=lambda p: (h(seed, p), p))) for t in free[:2])
            used |= {t for t, _ in out[k]}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "performance_id long, performer string, work_title string, instrumental boolean, language string")


def some(rng, n):
    return [(k, f"band{rng.integers(0, n // 6)}" if rng.random() < 0.9 else None, f"song {rng.integers(0, n // 3)}", bool(rng.random() < 0.15), str(rng.choice(["en", "de", "fr", ""]))) for k in range(n)]


def test_pairs_equal_those_of_keys_one_by_one(spark):
    rng = np.random.default_rng(4)
    for seed in range(3):
        rows = some(rng, 240)
        exclude = [(f"song {k}",) for k in range(8)]
        got = {r["performer"]: ((r["title_a"], r["a"]), (r["title_b"], r["b"])) for r in sampling.one_pair_a_key(frame(spark, rows).filter("not instrumental"), "performer", seed, spark.createDataFrame(exclude, "work_title string")).collect()}
        want = one_by_one(rows, "performer", seed, {t for t, in exclude})
        assert got == want and len(got) > 10


def test_a_work_whose_first_performer_has_no_partner_is_not_lost(spark):
    # only by its second performance can the song have a partner, whichever is drawn first
    rows = [(1, "alone", "shared song", False, "en"), (2, "duo", "shared song", False, "en"), (3, "duo", "other song", False, "en")]
    for seed in range(6):
        got = sampling.one_pair_a_key(frame(spark, rows), "performer", seed).collect()
        assert [{r["title_a"], r["title_b"]} for r in got] == [{"shared song", "other song"}]


def test_performers_then_languages_share_what_is_used(spark):
    rng = np.random.default_rng(9)
    rows = some(rng, 150)
    exclude = spark.createDataFrame([("song 1",)], "work_title string")
    got = sampling.matched_negatives(frame(spark, rows), exclude, 5).collect()
    used = {"song 1"}
    want = {("negative_same_performer", k): v for k, v in one_by_one(rows, "performer", 5, used).items()}
    want |= {("negative_same_language", k): v for k, v in one_by_one(rows, "language", 5, used).items()}
    assert {(r["kind"], r["key"]): ((r["title_a"], r["a"]), (r["title_b"], r["b"])) for r in got} == want
    titles = [t for r in got for t in (r["title_a"], r["title_b"])]
    assert len(titles) == len(set(titles)) and "song 1" not in titles
    few = sampling.matched_negatives(frame(spark, rows), exclude, 5, 4).collect()
    assert len(few) == 4 and {r["kind"] for r in few} == {"negative_same_performer"} and {(r["kind"], r["key"]) for r in few} <= set(want)
    assert sampling.matched_negatives(frame(spark, []), exclude, 5, 4).count() == 0


def test_a_sample_uses_each_work_once(spark):
    rng = np.random.default_rng(11)
    title = lambda k: f"a rather long title {k}"
    rows = [(k, f"band{rng.integers(0, 9)}", title(k // 3), False, "en" if k % 6 < 3 else "de") for k in range(90)]  # thirty works of three performances
    rows += [(1000 + k, f"band{rng.integers(0, 9)}", title(500 + k), False, str(rng.choice(["en", "fr"]))) for k in range(40)]  # forty of one
    for singles in (True, False):
        got = sampling.sample_pairs(frame(spark, rows), 12, 8, 3, singles).collect()
        pos, neg = [r for r in got if r["label"] == 1], [r for r in got if r["label"] == 0]
        assert len(pos) == 12 and len(neg) == 8 and all(r["other_work_title"] is None and r["left_id"] // 3 == r["right_id"] // 3 for r in pos)
        titles = [r["work_title"] for r in pos] + [t for r in neg for t in (r["work_title"], r["other_work_title"])]
        assert len(titles) == len(set(titles)) and all((r["left_id"] >= 1000) == singles == (r["right_id"] >= 1000) for r in neg)
        by = {r[0]: r for r in rows}
        assert all(r["language"] == (by[r["left_id"]][4] if by[r["left_id"]][4] == by[r["right_id"]][4] else None) for r in neg)
