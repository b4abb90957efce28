import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.functions import text as tx
from runledger.operators import consensus, similarity

RAFT_A = "Raft elects a leader using randomized election timeouts and replicates the log through that leader"
RAFT_B = "Raft elects a leader using randomized election timeouts and then replicates the log through the leader"
PAXOS = "Paxos reaches agreement with proposers and acceptors exchanging numbered ballots across quorums"
SCHEMA = "job_id STRING, task_id BIGINT, stage INT, title STRING, kind STRING, output STRING, confidence DOUBLE, passed BOOLEAN"


def answers(spark, *items, kind="answer", job="j"):
    data = [(job, i, 0, f"t{i:04d}", kind, text, conf, True) for i, (text, conf) in enumerate(items)]
    return spark.createDataFrame(data, SCHEMA)


def positioned(df):
    return similarity.positioned(df, consensus.report_order())


def brute_tokens(text):
    word, out = "", set()
    for ch in text + " ":
        if ch.isalnum():
            word += ch
        else:
            if len(word.encode()) > 3:
                out.add(word.lower())
            word = ""
    return out


def brute_sim(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_tokens_keep_words_by_bytes(spark):
    df = spark.createDataFrame([("Été abc Über-plan the x1234",)], "t STRING")
    assert df.select(tx.token_set(F.col("t"))).first()[0] == sorted(["été", "über", "plan", "x1234"])


def test_similarity_bands():
    assert brute_sim(brute_tokens(RAFT_A), brute_tokens(RAFT_B)) > 0.6
    assert brute_sim(brute_tokens(RAFT_A), brute_tokens(PAXOS)) < 0.3


def test_majority_and_weight(spark):
    """Three jobs at once: a clear majority, a confident minority, and a lone answer."""
    df = answers(spark, (RAFT_A, 0.6), (RAFT_B, 0.6), (PAXOS, 0.9), job="clear")
    df = df.unionByName(answers(spark, (RAFT_A, 0.2), (RAFT_B, 0.2), (PAXOS, 0.99), job="bold"))
    df = df.unionByName(answers(spark, (RAFT_A, 0.5), job="lone"))
    clustered = similarity.greedy_clusters(positioned(df), fixed.SAME_ANSWER).cache()
    most = {r.job_id: r for r in consensus.decide(clustered, False).collect()}
    heavy = {r.job_id: r for r in consensus.decide(clustered, True).collect()}
    assert set(most) == set(heavy) == {"clear", "bold"}
    assert most["clear"].winning_task in (0, 1) and most["clear"].agreement_rate == pytest.approx(2 / 3)
    assert most["clear"].distinct_positions == 2
    assert most["bold"].winning_task in (0, 1) and heavy["bold"].winning_task == 2


def test_conflicts(spark):
    df = answers(spark, (RAFT_A, 0.5), (PAXOS, 0.5), job="apart")
    df = df.unionByName(answers(spark, (RAFT_A, 0.5), (RAFT_B, 0.5), job="same"))
    c = similarity.greedy_clusters(positioned(df), fixed.SAME_ANSWER).cache()
    found = consensus.conflict_page(consensus.conflict_founders(c), consensus.conflict_exceptions(c), 0, 10).collect()
    assert [(r.job_id, r.number, r.left_claim == r.right_claim) for r in found] == [("apart", 0, False)]
    assert rows(consensus.conflict_counts(c).select("job_id", "conflicts")) == [("apart", 1), ("apart", 1), ("same", 0)]


def test_redundancy(spark):
    df = answers(spark, (RAFT_A, 0.5), (RAFT_A, 0.5), (PAXOS, 0.5), kind="work")
    assert rows(similarity.drop_redundant(positioned(df), fixed.REDUNDANT).select("task_id")) == [(0,), (2,)]


def family_texts(seed, n=90):
    """Copies, near copies and unrelated texts; some without any long word."""
    rng = random.Random(seed)
    vocabulary = [f"word{i:03d}" for i in range(60)]
    bases = [rng.sample(vocabulary, rng.randrange(6, 14)) for _ in range(5)]
    out = []
    for _ in range(n):
        base = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            if rng.random() < 0.5:
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            else:
                base.append(rng.choice(vocabulary))
        rng.shuffle(base)
        out.append(" ".join(base) if rng.random() > 0.06 else "a b c")
    return out


def brute_clusters(texts, t):
    sets, clusters, label = [brute_tokens(x) for x in texts], [], {}
    for i, s in enumerate(sets):
        home = next((c for c in clusters if any(brute_sim(sets[m], s) >= t for m in c)), None)
        if home is None:
            clusters.append([i])
            label[i] = i
        else:
            home.append(i)
            label[i] = home[0]
    return label


def brute_kept(texts, t):
    sets, kept = [brute_tokens(x) for x in texts], []
    for i, s in enumerate(sets):
        if not any(brute_sim(sets[k], s) >= t for k in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("seed", [1])
def test_greedy_clusters_equal_single_pass(spark, seed):
    texts = family_texts(seed)
    df = similarity.greedy_clusters(positioned(answers(spark, *[(x, 0.5) for x in texts])), 0.6)
    at = {r.pos: r.task_id for r in df.collect()}
    assert {r.task_id: at[r.label] for r in df.collect()} == brute_clusters(texts, 0.6)


@pytest.mark.parametrize("seed, budget, t", [(3, 16, 0.85), (4, 0, 0.6)])
def test_redundancy_equals_single_pass(spark, seed, budget, t, monkeypatch):
    monkeypatch.setattr(similarity, "PAIRS_PER_POSTING", budget)  # 0 forces the leader rounds
    monkeypatch.setattr(similarity, "MAX_LEADER_ROUNDS", 3)
    texts = family_texts(seed, 100)
    df = similarity.drop_redundant(positioned(answers(spark, *[(x, 0.5) for x in texts])), t)
    assert sorted(r.task_id for r in df.collect()) == brute_kept(texts, t)


def test_similar_pairs_equal_all_pairs(spark):
    texts = family_texts(9, 60)
    df = positioned(answers(spark, *[(x, 0.5) for x in texts]))
    sets = similarity.classes(df)
    first = {}
    for i, x in enumerate(texts):
        first.setdefault(frozenset(brute_tokens(x)), i)
    ids = sorted(first.values())
    task = {r.pos: r.task_id for r in df.collect()}
    for t in (0.3, 0.7):
        want = {(a, b) for a in ids for b in ids if a < b and brute_sim(brute_tokens(texts[a]), brute_tokens(texts[b])) >= t
                and brute_tokens(texts[a])}
        got = {(task[r.a], task[r.b]) for r in similarity.similar_pairs(sets, t).collect()}
        assert got == want


def test_evidence_merge(spark):
    data = [("j", i, 0, f"s{i}", "c", i / 40) for i in range(30)] + [("j", i, 1, "shared", "x", 0.5 + i / 100) for i in range(30)]
    items = spark.createDataFrame(data, "job_id STRING, pos BIGINT, position INT, source STRING, claim STRING, support DOUBLE")
    got = consensus.merge_evidence(items).orderBy("rank").collect()
    assert len(got) == 20 and [r.support for r in got] == sorted((r.support for r in got), reverse=True)
    assert sum(r.source == "shared" for r in got) == 1
    assert next(r.support for r in got if r.source == "shared") == 0.5


def test_final_report(spark):
    """Four jobs at once, one per way a summary comes about."""
    work = answers(spark, (RAFT_A, 0.5), (PAXOS, 0.9), kind="work", job="work")
    work = work.withColumn("passed", F.col("task_id") == 0)
    debate = answers(spark, (RAFT_A, 0.6), (RAFT_B, 0.6), (PAXOS, 0.3), job="debate")
    merged = answers(spark, (PAXOS, 0.6), kind="merge", job="merged")
    empty = answers(spark, (PAXOS, 0.6), kind="vote", job="empty")
    df = work.unionByName(debate).unionByName(merged).unionByName(empty)
    names = ["work", "debate", "merged", "empty"]
    jobs = spark.createDataFrame([(n, "goal", "debate" if n == "debate" else "parallel") for n in names],
                                 "job_id STRING, objective STRING, strategy STRING")
    counts = spark.createDataFrame([(n, 1, 2) for n in names], "job_id STRING, completed BIGINT, total BIGINT")
    none = spark.createDataFrame([], "job_id STRING, task_id BIGINT, position INT, source STRING, claim STRING, support DOUBLE")
    out = {r.job_id: r for r in consensus.final_results(jobs, df, counts, fixed.kinds(spark), none).collect()}
    assert out["work"].outputs == 1 and out["work"].confidence_score == pytest.approx(0.25)
    assert out["work"].summary == f"Findings for: goal\n\n- t0000: {RAFT_A}"
    assert out["debate"].summary.startswith("Consensus (80% agreement across 3 answers): Raft") and out["debate"].conflicts == 1
    assert out["merged"].summary == PAXOS
    assert out["empty"].summary == "No validated output was produced for: goal" and out["empty"].confidence_score == 0.0


def test_pairs_by_bounds_and_grid_equal_all_pairs(spark, monkeypatch):
    """Every pair at or above the threshold, whatever the blocks; most others end where they meet."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    base = [rng.sample(words, rng.randint(1, 25)) for _ in range(30)]
    texts = [" ".join(b[: rng.randint(1, len(b))] + rng.sample(words, rng.randint(0, 5))) for b in base for _ in range(6)]
    df = positioned(answers(spark, *[(x, 0.5) for x in texts]))
    sets = similarity.classes(df)
    tokens = {r.pos: frozenset(r.tokens) for r in sets.collect()}
    for threshold in (0.3, 0.5, 0.8):
        due = {(a, b) for a in tokens for b in tokens if a < b and tokens[a] & tokens[b] and len(tokens[a] & tokens[b]) / len(tokens[a] | tokens[b]) >= threshold}
        for size in (2_000, 5):
            monkeypatch.setattr(similarity, "GRID_POSTINGS", size)
            assert {(r.a, r.b) for r in similarity.similar_pairs(sets, threshold).collect()} == due
        coded = similarity.encode(sets)
        tried = similarity._candidates(similarity.postings(coded, threshold), threshold).count()
        prefix = {r.pos: set() for r in coded.collect()}
        for r in similarity.postings(coded, threshold).collect():
            prefix[r.pos].add(r.tok)
        size_of = {r.pos: len(r.ids) for r in coded.collect()}
        met = sum(bool(prefix[a] & prefix[b]) and min(size_of[a], size_of[b]) >= threshold * max(size_of[a], size_of[b]) for a in prefix for b in prefix if a < b)
        assert len(due) <= tried <= met and (tried - len(due)) * 2 <= met - len(due)


def test_conflict_pages_hold_every_pair_once(spark):
    df = answers(spark, *[(x, 0.5) for x in family_texts(5, 60)])
    c = similarity.greedy_clusters(positioned(df), fixed.SAME_ANSWER).cache()
    heads = sorted((r.pos, r.task_id, frozenset(r.tokens)) for r in consensus.representatives(c).collect())
    alike = lambda a, b: bool(a & b) and len(a & b) / len(a | b) > fixed.DISAGREEMENT
    due = {(a[1], b[1]) for i, a in enumerate(heads) for b in heads[i + 1 :] if not alike(a[2], b[2])}
    founders, exceptions = consensus.conflict_founders(c).cache(), consensus.conflict_exceptions(c).cache()
    n = len(heads) * (len(heads) - 1) // 2
    pages = [consensus.conflict_page(founders, exceptions, at, n // 2 + 1).collect() for at in (0, n // 2 + 1, 2 * n)]
    found = [(r.left_task, r.right_task) for page in pages for r in page]
    assert len(found) == len(set(found)) and set(found) == due and not pages[2]


def test_long_unlike_sets_are_not_compared_word_by_word(spark, monkeypatch):
    """Sets too long for their signatures, with many rare words in common, but none alike."""
    rng = random.Random(3)
    words = [f"word{i:03d}" for i in range(650)]
    sets = similarity.classes(positioned(answers(spark, *[(" ".join(rng.sample(words, 500)), 0.5) for _ in range(40)])))
    compared, verify = [], similarity._verify
    monkeypatch.setattr(similarity, "_verify", lambda pairs, *rest: compared.append(pairs.count()) or verify(pairs, *rest))
    assert similarity.keep_first(sets, 0.85).count() == 40 and sum(compared) == 0


def test_words_of_one_hash_stay_two_words(spark):
    """Numbers of a set differ, and sets alike only by hash are told apart by their words."""
    same = spark.range(300_000).select(F.concat(F.lit("word"), "id").alias("w")).groupBy(F.hash("w").alias("h"))
    left, right = same.agg(F.sort_array(F.collect_list("w")).alias("ws")).filter("size(ws) > 1").first().ws[:2]
    shared = [f"shared{i}" for i in range(5)]
    texts = [[left, right, *shared], [left, right, *shared, "more"], [left, *shared[:4]], [right, *shared[:4]]]
    df = positioned(answers(spark, *[(" ".join(x), 0.5) for x in texts]))
    assert all(len(set(r.ids)) == len(r.ids) == len(texts[i]) for i, r in enumerate(similarity.encode(similarity.classes(df)).orderBy("pos").collect()))
    assert sorted(r.task_id for r in similarity.drop_redundant(df, 0.85).collect()) == [0, 2, 3]


def test_outputs_are_not_written_again_without_texts(spark):
    df = answers(spark, (RAFT_A, 0.5), (RAFT_B, 0.5))
    placed = similarity.positioned(df, consensus.report_order(), texts=False)
    assert "output" not in placed.columns and placed.select("tokens").collect() == positioned(df).select("tokens").collect()


def test_unlike_sets_of_one_vocabulary_share_few_keys(spark):
    """Twice the sets over the same words: no more keys in common, as no single word is one."""
    rng = random.Random(6)
    words = [f"word{i:04d}" for i in range(3_000)]
    weights = [1 / (i + 5) for i in range(3_000)]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([40, 150, 400]))) for _ in range(400)]
    texts += [x + f" added{i}" for i, x in enumerate(texts[:20])]
    sets = similarity.classes(positioned(answers(spark, *[(x, 0.5) for x in texts])))
    tokens = {r.pos: frozenset(r.tokens) for r in sets.collect()}
    keys = {}
    for r in similarity.postings(similarity.encode(sets), 0.85).collect():
        keys.setdefault((r.job_id, r.tok), set()).add(r.pos)
    met = {(a, b) for ps in keys.values() for a in ps for b in ps if a < b}
    due = {(a, b) for a in tokens for b in tokens if a < b and brute_alike(tokens[a], tokens[b], 0.85)}
    assert len(due) >= 20 and due <= met and len(met) <= len(texts)


@pytest.mark.parametrize("t", [0.85, 0.5, 0.3])
def test_sets_at_the_threshold_share_a_key(spark, t):
    """As different as the threshold lets them be, at every size and across size classes."""
    rng = random.Random(11)
    words = [f"term{i:04d}" for i in range(2_000)]
    texts = []
    for n in [*range(1, 30), 60, 113, 114, 300]:
        base = rng.sample(words, n)
        texts += [" ".join(base), " ".join(base[: max(1, -int(-n * t // 1))]), " ".join(base + rng.sample(words, int(n / t) - n))]
    sets = similarity.classes(positioned(answers(spark, *[(x, 0.5) for x in texts])))
    tokens = {r.pos: frozenset(r.tokens) for r in sets.collect()}
    due = {(a, b) for a in tokens for b in tokens if a < b and brute_alike(tokens[a], tokens[b], t)}
    found = {tuple(r) for r in similarity._candidates(similarity.postings(similarity.encode(sets), t), t).collect()}
    assert due and due <= found


def brute_alike(a, b, t):
    return bool(a & b) and len(a & b) / len(a | b) >= t
