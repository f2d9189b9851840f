"""Sequences of regions, cut from chunks of a genome."""

import random

from locusflow.operators import kmers as K


def test_sequences_of_regions(spark):
    """Within a chunk, over two, over many, beyond the last one and empty; sequences of short regions are not shuffled."""
    rng = random.Random(4)
    whole = {c: "".join(rng.choices("ACGT", k=47)) for c in "ab"}
    genome = [(c, i, s[i * 10 : i * 10 + 10]) for c, s in whole.items() for i in range(5)]
    regions = [(i, rng.choice("abc"), a := rng.randrange(60), a + rng.choice((0, 1, 4, 9, 12, 35)), rng.choice("+-")) for i in range(150)]
    r = spark.createDataFrame(regions, "id long, chrom string, start long, end long, strand string")
    g = spark.createDataFrame(genome, "chrom string, chunk long, seq string")
    flip = str.maketrans("ACGT", "UGCA")
    text = {i: (t.translate(flip)[::-1] if st == "-" else t.replace("T", "U")) for i, c, s, e, st in regions for t in [whole.get(c, "")[s:e]]}
    assert {x.id: x.seq for x in K.region_sequences(r, g, 10, whole=True).collect()} == text
    known = {i: text[i] for i, c, s, e, _ in regions if c in whole and (s // 10 < 5 or (e - 1) // 10 < 5)}
    assert {x.id: x.seq for x in K.region_sequences(r, g, 10).collect()} == known
