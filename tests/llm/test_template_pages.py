"""Near-duplicates among pages of one template, which share most of their words but are not alike."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scoutline.llm import neardup
from scoutline.llm.common import WordHasher, string_buffers
from tests.llm.test_python_operators import brute_near, near


def pages(n, seed, template=240, own=46):
    """Pages of which any two have a similarity of about 0.71."""
    rng = random.Random(seed)
    frame = [f"t{i}" for i in range(template)]
    cut = template // 2
    return [" ".join(frame[:cut] + [f"p{rng.getrandbits(60)}" for _ in range(own)] + frame[cut:]) for _ in range(n)]


def rare_of(spark, texts, width=4):
    data, offsets = string_buffers(pa.array(texts))
    sets, starts = neardup.shingle_sets(WordHasher(), data, offsets, width)
    rows = [(i, sets[starts[i] : starts[i + 1]].astype(np.int64).tolist()) for i in range(len(texts))]
    rare = neardup._rare(spark.createDataFrame(rows, "id long, members array<long>"), 80)
    owned = rare.join(neardup._shared(rare), "key").withColumn("own", F.col("id"))
    return {k: set(v) for k, v in rows}, rare, neardup._met_by_rare(owned, 80)


def test_no_pair_of_the_similarity_is_lost(spark):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(90)]
    texts = []
    for _ in range(150):  # cut, extended and edited copies, so that sizes differ and many pairs lie near the limit
        words = base[rng.randrange(12) : 90 - rng.randrange(12)] + [f"x{rng.randrange(40)}" for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"y{rng.randrange(9)}"
        texts.append(" ".join(words))
    sets, _, met = rare_of(spark, texts)
    got = {tuple(sorted(p)) for p in met.distinct().collect()}
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    right = {(i, j) for i in sets for j in range(i + 1, len(texts)) if alike(sets[i], sets[j])}
    assert len(right) > 500 and right <= got


def test_twice_the_pages_are_no_more_than_twice_the_work(spark):
    work = []
    for n in (1500, 3000):
        texts = pages(n, 5)
        texts += [t.replace("p1", "q1", 2) for t in texts[: n // 50]]  # near copies of some
        _, rare, met = rare_of(spark, texts)
        work.append((rare.count(), met.distinct().count()))
        assert work[-1][1] >= n // 60
    assert work[1][0] <= 2.2 * work[0][0] and work[1][1] <= 2.2 * work[0][1] + 10, work


def test_templates_in_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "OUTSIDERS", 20)
    monkeypatch.setattr(neardup, "BLOCK", 50)
    texts = pages(300, 8)
    rng = random.Random(1)
    for t in texts[:20]:  # groups of near copies, and chains of them
        for _ in range(4):
            words = t.split(" ")
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = f"z{rng.getrandbits(40)}"
            t = " ".join(words)
            texts.append(t)
    rng.shuffle(texts)
    rows = [(i + 1, t, 0) for i, t in enumerate(texts)]
    assert near(spark, rows) == brute_near({d: t for d, t, _ in rows})
