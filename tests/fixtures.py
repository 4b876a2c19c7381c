"""Sets as Python sets, built by rule."""

import random


def bernoulli(universe: int, density: float, seed: int) -> set[int]:
    rng = random.Random(seed)
    return {i for i in range(universe) if rng.random() < density}


THREE_KINDS = set(range(100)) | set(range(65536, 115536)) | set(range(131072, 141072))
PROMOTE_MIX = {10 * i for i in range(100)} | set(range(65536, 115536)) | set(range(131072, 141072))
STEPPED = {3 * i for i in range(100)} | set(range(65536, 105536)) | set(range(131072, 151072))
SETS = {
    "single": {42}, "three": THREE_KINDS, "mix": PROMOTE_MIX, "stepped": STEPPED, "boundary": {65535, 65536}, "full": set(range(65536)),
    "runs": set(range(1000, 5000)) | set(range(70000, 80000)), "sparse": bernoulli(200_000, 0.005, 1),
}


def batch(variant: int) -> set[int]:
    out = {(i * (13 + variant)) % 65536 for i in range(200)} | set(range(65536 + 1000 * variant, 125536)) | set(range(131072 + 100 * variant, 181072))
    return out | ({196608 + 7 * i for i in range(50)} if variant >= 2 else set())


def frame(spark, sets: dict[str, set[int]]):
    import pyarrow as pa

    names = [n for n, s in sets.items() for _ in s]
    ids = [i for s in sets.values() for i in sorted(s)]
    return spark.createDataFrame(pa.table({"filter_id": pa.array(names, pa.string()), "id": pa.array(ids, pa.int64())}))


def sets_of(df) -> dict[str, set[int]]:
    table = df.select("filter_id", "id").toArrow()
    out: dict[str, set[int]] = {}
    for n, i in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
        assert i not in out.setdefault(n, set()), "an id twice"
        out[n].add(i)
    return out
