"""Alias pairs against all pairs of names."""

import random

from lodestar.functions.text import indel_ratio
from lodestar.plans.texts import text_fuzzy_aliases


def test_aliases_equal_all_pairs(spark, tmp_path):
    rng = random.Random(4)
    names = ["Hannibal Barca", "Hanibal Barca", "Barca Hannibal", "HANNIBAL barca", "Scipio Africanus", "Scipio Afrcanus", "ab", "abc", "", " "]
    long = "Konstantin Alexandrovich Rokossovsky of the second front"
    names += [long, long + " army x", long + " armies y", long.replace("Konstantin", "Konstntin")]
    for _ in range(60):
        base = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 4)))
        for _ in range(2):
            cut = rng.randrange(len(base))
            names += [base, base[:cut] + base[cut + 1 :], base[:cut] + "x" + base[cut:], base[:cut] + "y" + base[cut + 1 :]]
    names = list(dict.fromkeys(names))
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r.left, r.right, round(r.ratio, 6)) for r in text_fuzzy_aliases(spark, str(tmp_path)).collect())
    low = [n.lower() for n in names]
    want = [(i, j, round(indel_ratio(low[i], low[j]), 6)) for i in range(len(low)) for j in range(i + 1, len(low)) if indel_ratio(low[i], low[j]) >= 92]
    assert got == want and {(0, 1), (0, 3)} <= {x[:2] for x in got}
