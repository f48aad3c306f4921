"""Similar texts that the bounded steps leave apart meet in the bands they share."""

import random

from tidewave.llm import simhash


def test_every_similar_pair_that_shares_a_band_is_joined(spark):
    """700 copies of one text with 0 to 24 changed words, of which three followers a band miss some."""
    r = random.Random(8)
    base = [f"W{r.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(700):
        words = list(base)
        for at in r.sample(range(150), r.randrange(0, 25)):
            words[at] = f"W{r.randrange(5000)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs).collect()}
    bands = {x["doc_id"]: x["bands"] for x in simhash.sketches(docs, 5, 42, "doc_id", "text").collect()}
    sets = [simhash.shingles(t, 5) for t in texts]
    met = [(a, b) for a in range(700) for b in range(a) if any(x == y for x, y in zip(bands[a], bands[b], strict=True))]
    alike = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    apart = [(a, b) for a, b in alike if got[a] != got[b]]
    print(len(alike), len(apart))
    assert len(alike) > 4000 and not apart
