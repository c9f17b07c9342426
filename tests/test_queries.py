import pytest

from conftest import SF, same_rows
from graphloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    same_rows(catalogue.queries()[name](spark, SF), duck, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_semantic_dedup_is_a_greedy_pass_over_all_embeddings(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(120, 64))
    vectors[40:] = vectors[0] + rng.normal(size=(80, 64)) * rng.choice([0.05, 0.2, 0.3], (80, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = {str(i): (u := np.array(v, np.float32).astype(float)) / np.linalg.norm(u) for i, v in rows}
    kept, want = [], {}
    for name in sorted(unit):
        want[name] = next((k for k in kept if unit[k] @ unit[name] >= 0.95), name)
        kept += [name] * (want[name] == name)
    assert 45 < len(kept) < 110
    got = catalogue.queries()["semantic_dedup"](spark, str(tmp_path)).collect()
    assert {r["name"]: r["chosen"] for r in got} == want and len(got) == 120
