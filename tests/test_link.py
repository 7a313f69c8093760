import math
import random
from collections import Counter

import pytest

from samplelake.operators.link import alias_scores, link_concepts


def brute(mentions, aliases, concepts, k, threshold):
    """All pairs, in plain Python."""
    names = sorted({a.strip().lower() for _, a in aliases if len(a.strip()) >= 3})
    grams = {n: Counter(n[i : i + 3] for i in range(len(n) - 2)) for n in names}
    df = Counter(g for c in grams.values() for g in c)
    idf = {g: math.log((1 + len(names)) / (1 + n)) + 1 for g, n in df.items()}

    def vector(counts):
        v = {g: n * idf[g] for g, n in counts.items() if g in idf}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {g: w / norm for g, w in v.items()}

    vectors = {n: vector(c) for n, c in grams.items()}
    known = {c: (name, text) for c, name, text in concepts}
    out = {}
    for mention in mentions:
        if mention is None:
            continue
        low = mention.strip().lower()
        v = vector(Counter(low[i : i + 3] for i in range(len(low) - 2))) if len(low) >= 3 else {}
        ranked = []
        for concept, alias in {(c, a.strip().lower()) for c, a in aliases}:
            if alias in vectors:
                score = round(sum(w * vectors[alias].get(g, 0.0) for g, w in v.items()), 6)
                if score > threshold:
                    ranked.append((-score, concept, alias))
        best = {}
        for score, concept, _ in sorted(ranked)[:k]:
            if known.get(concept, (None, None))[1] is not None:
                best[concept] = max(best.get(concept, 0.0), -score)
        if best:
            concept = min(best, key=lambda c: (-best[c], c))
            out[mention] = (concept, best[concept], f"{known[concept][0]} [{concept}]")
        else:
            out[mention] = (None, None, mention)
    return out


@pytest.mark.parametrize("k,threshold", [(30, 0.5), (2, 0.3), (30, 0.0), (30, 0.9), (1, 0.5)])
def test_links_equal_all_pairs(spark, k, threshold):
    rng = random.Random(k)
    syllables = ["lu", "ng", "can", "cer", "li", "ver", "car", "ci", "no", "ma", "a", " "]
    names = ["".join(rng.choices(syllables, k=rng.randint(1, 6))) for _ in range(60)]
    aliases = [(f"C{rng.randint(0, 25):02d}", n) for n in names] + [("C01", "ab"), ("C02", "Lung Cancer"), ("C03", "lung cancer")]
    concepts = [(f"C{i:02d}", f"name {i}", None if i % 5 == 0 else "text") for i in range(26)]
    mentions = ["".join(rng.choices(syllables, k=rng.randint(1, 6))) for _ in range(60)] + ["lung cancer", " LUNG cancer ", "ab", "", None, "zzzz"]
    links = link_concepts(
        spark.createDataFrame([(m,) for m in mentions], "mention string"),
        spark.createDataFrame(aliases, "concept_id string, alias string"),
        spark.createDataFrame(concepts, "concept_id string, canonical_name string, definition string"),
        k, threshold,
    )
    got = {r["mention"]: (r["concept_id"], r["score"], r["label"]) for r in links.collect()}
    want = brute(mentions, aliases, concepts, k, threshold)
    assert got == want


def test_rare_grams_only_in_the_join(spark):
    """Names that share a frequent beginning do not meet unless their rare ends are alike."""
    aliases = spark.createDataFrame([(str(i), f"common part of names {i:04d}{i * 7919 % 10007:05d}") for i in range(300)], "concept_id string, alias string")
    mentions = aliases.selectExpr("alias AS mention")
    scores = alias_scores(mentions, aliases, 0.95)
    assert scores.filter("mention = alias").count() == 300


def test_a_gram_of_half_of_all_aliases(spark, monkeypatch):
    from samplelake.operators import link

    monkeypatch.setattr(link.candidate_pairs, "__defaults__", (50,))
    rng = random.Random(2)
    aliases = [(f"C{i % 26:02d}", ("lun" if i % 2 else "") + "".join(rng.choices("abcdefgh", k=rng.randint(1, 5)))) for i in range(200)]
    concepts = [(f"C{i:02d}", f"name {i}", "text") for i in range(26)]
    mentions = [a for _, a in aliases[::3]] + ["lun", "lung", "lunab"]
    links = link_concepts(
        spark.createDataFrame([(m,) for m in mentions], "mention string"),
        spark.createDataFrame(aliases, "concept_id string, alias string"),
        spark.createDataFrame(concepts, "concept_id string, canonical_name string, definition string"), 30, 0.4,
    )
    got = {r["mention"]: (r["concept_id"], r["score"], r["label"]) for r in links.collect()}
    assert got == brute(mentions, aliases, concepts, 30, 0.4)


def test_vectors_are_fetched_for_distinct_pairs_only(spark):
    from samplelake.operators import link

    aliases = spark.createDataFrame([("C", f"alias number {i}") for i in range(50)], "concept_id string, alias string")
    idf, known = link.alias_vectors(aliases)
    asked = link._numbered(link._vectors(link._gram_counts(aliases.selectExpr("alias AS mention"), "mention"), idf, "mention"), "mention")
    pairs = link.candidate_pairs(asked, known, 0.5)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "vec#" not in plan and pairs.count() == pairs.distinct().count() > 0
