import pytest

from mapstats.operators import digests as X
from mapstats.operators.contracts import ContractError

SCHEMA = "k int, a string, b double"


def rows():
    return [(k, None if k % 7 == 0 else f"x{k % 5}|", k / 3) for k in range(300)] + [(None, "", None)]


def digest(df, leaves=8):
    return tuple(X.root(X.leaf_digests(df, ["k"], leaves)).first())


def test_roots_do_not_depend_on_order_and_see_every_change(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    whole = digest(df)
    assert whole[0] == 301 and digest(df.repartition(7).orderBy("b")) == whole and digest(df.select("b", "k", "a")) == whole
    for changed in (df.where("k <> 5 OR k IS NULL"), df.replace("", "\\N"), df.unionByName(df.limit(1)), df.selectExpr("k", "a", "CASE WHEN k = 9 THEN b + 1e-9 ELSE b END AS b")):
        assert digest(changed) != whole
    swapped = spark.createDataFrame([(1, "2:ab|c", None)], SCHEMA), spark.createDataFrame([(1, "2:ab", None)], SCHEMA)
    assert digest(swapped[0]) != digest(swapped[1])
    assert digest(df.limit(0))[0] == 0


@pytest.mark.parametrize("leaves", [1, 8, 1024])
def test_differences_are_found_to_the_field(spark, leaves):
    df = spark.createDataFrame(rows(), SCHEMA)
    other = [(k, "new" if k == 14 else a, b if k != 4 else None) for k, a, b in rows() if k != 100] + [(1000, None, 1.0)]
    got = X.differences(df, spark.createDataFrame(other, SCHEMA), ["k"], leaves)
    assert {tuple(r) for r in got.collect()} == {(14, "a", None, "new"), (4, "b", str(4 / 3), None), (100, "row", "there", None), (1000, "row", None, "there")}
    assert X.differences(df, df, ["k"], leaves).count() == 0


def test_provenance_fails_closed(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    one = X.provenance({"t": (df, ["k"])}, {"b": 1, "a": [2.5, None]})
    assert X.verify(one, X.provenance({"t": (df.repartition(3), ["k"])}, {"a": [2.5, None], "b": 1})) is one
    with pytest.raises(ContractError, match="differs: settings"):
        X.verify(one, X.provenance({"t": (df, ["k"])}, {"b": 2, "a": [2.5, None]}))
    with pytest.raises(ContractError, match="differs: t"):
        X.verify(one, X.provenance({"t": (df.where("k > 0"), ["k"])}, {"b": 1, "a": [2.5, None]}))
