"""Near-duplicates of the pipeline against brute force over all pairs."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tidewater.llm import common, resemblance  # noqa: E402
from tidewater.llm.components import _settled  # noqa: E402


def grams(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def slow_components(texts, threshold=0.8):
    sets, of = [grams(t) for t in texts], list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) / len(a | b) >= threshold:
                low, high = sorted((of[i], of[j]))
                of = [low if c == high else c for c in of]
    return of


def planted():
    """Texts, and copies of them at similarities around and above 0.8."""
    rng = random.Random(6)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, texts = prose(50), []
    for i in range(40):
        words = prose(rng.choice((60, 150, 400))) + (passage if i % 3 == 0 else [])
        texts.append(" ".join(words))
        for share in (0.005, 0.01, 0.02, 0.025, 0.04):  # of words changed
            near = words.copy()
            for at in rng.sample(range(len(near)), max(1, int(share * len(near)))):
                near[at] = "changed"
            texts.append(" ".join(near))
    rng.shuffle(texts)
    return texts + [texts[3].upper(), texts[4].replace(" ", "\n "), None, "", "one two", "One  two", "one two three"]


def test_components_are_brute_forces(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in resemblance.similar_components(docs).collect()}
    want = dict(enumerate(slow_components(texts)))
    assert got == want
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == set(want.values())


@pytest.mark.parametrize("members", [2, 64])
def test_many_copies_of_one_text(spark, monkeypatch, members):
    """Copies nearer to their original than to each other, whose bands hold more sets than are tried in pairs."""
    rng = random.Random(8)
    monkeypatch.setattr(resemblance, "MEMBERS", members)
    words = [f"w{rng.randrange(4000)}" for _ in range(300)]
    texts = []
    for _ in range(60):
        near = words.copy()
        for at in rng.sample(range(300), 6):
            near[at] = f"c{rng.randrange(4000)}"
        texts.append(" ".join(near))
    texts.insert(40, " ".join(words))
    texts += [" ".join(f"o{rng.randrange(4000)}" for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["component_id"] for r in resemblance.similar_components(docs).orderBy("doc_id").collect()]
    assert got == slow_components(texts)


def test_band_keys():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    shared = []
    for _ in range(200):  # 889 of 1000 shared: a similarity of 0.8
        drawn = rng.choice(pool, 1111, replace=False)
        shared.append((resemblance.bands(np.sort(drawn[:1000])) == resemblance.bands(np.sort(drawn[111:]))).sum())
    assert abs(np.mean(shared) / resemblance.BANDS - 0.8**resemblance.ROWS) < 0.03 and np.mean(np.array(shared) > 0) > 0.98


def test_rows_of_one_id(spark):
    """A copy of row 3 that shares its id with a text of its own: the copy goes, the text stays, in any order of the three; repeated rows are one."""
    rows, want = [], []
    for k, order in enumerate(itertools.permutations(range(3))):
        text, own = (" ".join(f"{c}{k}x{i}" for i in range(30)) for c in "tu")
        three = [(10 * k + 3, text, 1), (10 * k + 5, text, 1), (10 * k + 5, own, 2)]
        rows += [three[i] for i in order] + [three[order[0]]]
        want += [three[0], three[2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").coalesce(1)
    assert sorted(map(tuple, resemblance.drop_near_duplicates(docs).collect())) == want


def test_copies_at_each_similarity(spark):
    """A text and one copy each, at 0.80 to 0.95: the copy goes."""
    rng = random.Random(7)
    texts, at = [], []
    for i in range(40):
        words = [f"t{i}w{rng.randrange(4000)}" for _ in range(200)]
        near = words.copy()
        for j in range(i % 4 + 1):
            near[20 + 40 * j] = "changed"
        texts += [" ".join(words), " ".join(near)]
        a, b = map(grams, texts[-2:])
        at.append(len(a & b) / len(a | b))
    assert min(at) < 0.83 and max(at) > 0.94 and all(x >= 0.8 for x in at)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(range(0, 80, 2))


def test_odd_rows(spark):
    clash = {c: "clash" for c in "set n row fp bands h a b c m first sets hashes shared degree block slot node component component_id low high".split()}
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other text"), (2, "a  b c d e f g"), (3, "x"), (None, "a b c d e f g"), (None, None)], "doc_id long, text string").withColumns({k: F.lit(v) for k, v in clash.items()})
    assert sorted(str(r["doc_id"]) for r in resemblance.drop_near_duplicates(docs).collect()) == ["1", "1", "3", "None", "None"]
    assert resemblance.drop_near_duplicates(docs.limit(0)).count() == 0


def templated(rng, groups, pairs, core, shared, own):
    """Texts of groups that share a template's core; two of a pair share some more, and each has words of its own."""
    texts, prose = [], lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    for _ in range(groups):
        template = prose(core)
        for _ in range(pairs):
            more = prose(shared)
            texts += [" ".join(template + more + prose(own)) for _ in range(2)]
    return texts


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("core, shared, own, within, across", [(355, 7, 38, 0.81, 0.79), (332, 28, 40, 0.80, 0.72), (340, 40, 20, 0.9, 0.75)])
@pytest.mark.parametrize("groups, pairs", [(1, 60), (5, 12)])
def test_pairs_of_a_template(spark, core, shared, own, within, across, groups, pairs):
    """Pairs at the threshold, or over it, among many texts that share most of their words and are just below it: each pair is found."""
    rng = random.Random(core + groups)
    texts = templated(rng, groups, pairs, core, shared, own)
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["component_id"] for r in resemblance.similar_components(docs).orderBy("doc_id").collect()]
    want = slow_components(texts)
    alike = [(i, j) for j in range(len(texts)) for i in range(j) if similarity(texts[i], texts[j]) >= 0.8]
    found = sum(got[i] == got[j] for i, j in alike)
    assert found >= 0.99 * len(alike) and len(alike) >= groups * pairs
    assert all(got[i] == want[i] or want[i] != i for i in range(len(texts)))  # nothing goes that brute force keeps


def test_prefix_pairs_are_all_pairs(spark, monkeypatch):
    """Every pair at the threshold of sets of different components, whatever shares a counter, and none of one component."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(resemblance, "COUNTERS", 64)
    rng = random.Random(12)
    texts = templated(rng, 2, 12, 70, 5, 4) + templated(rng, 1, 6, 9, 2, 1) + planted()[:60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = resemblance.id_and_text(docs)
    sets = resemblance.cut(resemblance.sketched(rows, 5))
    nodes = resemblance.cut(sets.select("set", "doc_id", "n", "fp").dropDuplicates(["set"]))
    apart = resemblance.cut(nodes.select("set", (F.col("doc_id") % 7).alias("c"), "n", "fp"))
    got = {tuple(sorted(r)) for r in resemblance.verified(resemblance.prefix_pairs(apart, nodes, rows, 0.8, 5), nodes, rows, 0.8, 5).collect()}
    of = {r["doc_id"]: r["set"] for r in nodes.collect()}
    want = {tuple(sorted((of[i], of[j]))) for i in of for j in of if i < j and i % 7 != j % 7 and similarity(texts[i], texts[j]) >= 0.8}
    assert got == want and len(want) > 20


def test_shuffle_files_go_with_their_frame(spark):
    """What a checkpoint, a table or a round of components shuffles is deleted then, without the driver's garbage collection; frames made before still give their rows."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    def settled(before):
        until = time.monotonic() + 10
        while files() - before and time.monotonic() < until:
            time.sleep(0.1)
        return files() - before

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    as_before, before = spark.conf.get(key), files()
    tally = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    kept = common.cut(tally.join(tally.select("k", F.col("n").alias("m")), "k"))
    assert settled(before) == set()
    with common.passing(spark):
        assert common.written(tally, "tally").count() == 7
        before = files()  # the count has a shuffle of its own
        assert common.written(tally, "tally").schema.names == ["k", "n"]
        assert settled(before) == set()
    assert not _settled(spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "u long, v long"))
    assert settled(before) == set()
    assert kept.count() == tally.count() == 7 and spark.conf.get(key) == as_before
