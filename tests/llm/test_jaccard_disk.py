"""What the join of shingle sets sends."""

import random

import pandas as pd
from pyspark.sql import functions as F

from studyloom.llm import jaccard_join as J


def test_nodes_travel_once_a_chunk_however_many_ranges(spark):
    rnd = random.Random(4)
    texts = [" ".join(str(rnd.randrange(10**6)) for _ in range(120)) for _ in range(400)]
    rows = [(k << 33, J.set_key(w := J.folded_words(t), len(J.shingles(w, 4)), 4), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["node", "key", "text"]), "node long, key binary, text string").coalesce(1)
    sent = df.mapInPandas(J._requests(4, 16), "part int, chunk long, told boolean, blob binary").agg(F.sum(F.length("blob")), F.count_if("told")).first()
    assert sent[1] == 1 and sent[0] < 400 * 117 * 7.5  # 56 bits a shingle less what order saves, a place of nine bits; with ids and sizes more than 8
