import random

import pytest

#: Extra columns under names that the operators use inside.
CLASHING = "row long, _row long, key string, cls long, label int, score double, ids string, shard int, slot long, n long, component_id long, size long, held_out boolean, _at long"


def random_text(rng: random.Random, n: int) -> str:
    words = ["Alpha", "beta", "gamma,", "délta", "epsilon.", "zeta", "eta", "THETA", "iota!", "42", "kappa\n", "don't", "Ünder", "été"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "x"]) for _ in range(n))


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    rows = [
        (1, None),
        (2, ""),
        (3, "   \n\t "),
        (4, "one"),
        (5, "one"),
        (6, "One two three"),
        (7, random_text(rng, 60_000)),
        (8, "x" * 300_000),
        (9, "ends with <|endoftext|> and more<|startoftext|>"),
        (10, "日本語のテキスト ΣΑΣ İ 👍🏽 \x00\x1c  ok"),
        (11, None),
        (None, "one"),
        (None, None),
        (12, "tie tie tie tie tie"),
        (12, "tie tie tie tie tie"),
        (13, "same id, first"),
        (13, "same id, second"),
        (-7, "negative id"),
        (2**62, "large id"),
    ]
    long = random_text(rng, 400)
    words = long.split(" ")
    for i in range(30):
        near = list(words)
        for _ in range(i // 6):
            near[rng.randrange(len(near))] = f"w{rng.randrange(1000)}"
        rows.append((100 + i, " ".join(near)))
    rows += [(200 + i, random_text(rng, rng.randrange(1, 300))) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward documents in three partitions, with clashing extra columns."""
    rows = awkward_rows()
    names = [c.split()[0] for c in CLASHING.split(", ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "text")
    df = df.selectExpr("*", *(f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASHING.split(", ")))
    assert set(names) <= set(df.columns)
    path = spark.conf.get("spark.checkpoint.dir") + "/awkward"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, awkward):
    return spark.createDataFrame([], awkward.schema)
