import numpy as np
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

import __spark_entry__
from octavox.functions import morton
from octavox.operators import clusters, grid, index, search
from octavox.operators import geometry as geo
import octavox.plans.clusters  # noqa: F401
from octavox.plans import geometry, indexing, queries  # noqa: F401
from octavox.sources import files, shapes


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = queries.REGISTRY[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.REGISTRY) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.REGISTRY[name](spark, SF).count() > 0


def test_entry_and_registry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["query_id", "object_id", "dist", "rank"]


def test_morton_round_trip(spark):
    cells = spark.range(16**3).select(*[F.shiftright("id", 4 * k).bitwiseAND(F.lit(15)).cast("int").alias(c) for k, c in enumerate("xyz")])
    code = cells.withColumn("code", morton.encode(F.col("x"), F.col("y"), F.col("z"), 4))
    x, y, z = morton.decode(F.col("code"), 4)
    assert code.where((x != F.col("x")) | (y != F.col("y")) | (z != F.col("z"))).count() == 0
    assert code.select("code").distinct().count() == 16**3


def golden(spark):
    cells = [(0, x, y, z) for x in range(4) for y in range(4) for z in range(4)] + [(1, 1, 1, 1)] + [(2, x, y, z) for x in range(2) for y in range(2) for z in range(2)]
    cells += [(3, x, y, z) for x in range(2) for y in range(4) for z in range(4)]
    return spark.createDataFrame(cells, "shape_id long, x int, y int, z int")


def test_golden_shapes(spark):
    words = shapes.to_words(golden(spark), 2)
    count = lambda d: {r["shape_id"]: r["n"] for r in d.groupBy("shape_id").agg(F.sum(F.bit_count("bits")).alias("n")).collect()}
    assert count(grid.shrink(words, 2))[0] == 64
    assert count(grid.grow(words, 2))[1] == 7
    assert count(grid.shrink(grid.grow(words, 2), 2))[1] == 1
    assert {r["shape_id"]: r["faces"] for r in grid.face_counts(words, 2).collect()} == {0: 96, 1: 6, 2: 24, 3: 64}
    assert {r["shape_id"]: r["n"] for r in grid.invert(words, 2).groupBy("shape_id").agg(F.sum(F.bit_count("bits")).alias("n")).collect()} == {1: 63, 2: 56, 3: 32}
    packed = search.packed(words)
    d = {(r["query_id"], r["object_id"]): r["dist"] for r in search.scored(packed, packed).collect()}
    assert d[2, 3] == 0.75 and d[0, 0] == 0 and all(d[a, b] == d[b, a] for a, b in d)


def voxel_sets(frame, levels):
    out = {}
    for r in shapes.to_voxels(frame, levels).collect():
        out.setdefault(r["shape_id"], set()).add((r["x"], r["y"], r["z"]))
    return out


@pytest.mark.parametrize("levels", [2, 3, 4])
def test_morphology_matches_voxels(spark, levels):
    """Words against plain sets of voxels, across block borders and the grid's edges."""
    rng, side = __import__("random").Random(levels), 1 << levels
    data = {i: {tuple(rng.randrange(side) for _ in range(3)) for _ in range(side**3 * i // 5)} for i in range(1, 6)}
    words = shapes.to_words(spark.createDataFrame([(i, *p) for i, own in data.items() for p in own], "shape_id long, x int, y int, z int"), levels)
    six = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    box = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]
    inside = lambda p: all(0 <= c < side for c in p)
    near = lambda p, how: [tuple(a + b for a, b in zip(p, o, strict=True)) for o in how]
    grown = lambda s: s | {q for p in s for q in near(p, six) if inside(q)}
    shrunk = lambda s: {p for p in s if all(q in s or not inside(q) for q in near(p, six))}
    want = {
        "grow": grown, "shrink": shrunk, "exposed": lambda s: s - shrunk(s),
        "interior": lambda s: {p for p in s if all(q in s or not inside(q) for q in near(p, box))},
        "solitary": lambda s: {p for p in s if not any(q in s for q in near(p, box))},
    }
    for name, rule in want.items():
        assert voxel_sets(getattr(grid, name)(words, levels), levels) == {i: rule(s) for i, s in data.items() if rule(s)}, name
    assert voxel_sets(grid.grow(words, levels, 2), levels) == {i: grown(grown(s)) for i, s in data.items()}
    assert voxel_sets(grid.shrink(words, levels, 2), levels) == {i: shrunk(shrunk(s)) for i, s in data.items() if shrunk(shrunk(s))}
    assert {r["shape_id"]: r["faces"] for r in grid.face_counts(words, levels).collect()} == {i: sum(q not in s for p in s for q in near(p, six)) for i, s in data.items()}
    assert grid.faces(words, levels).count() == sum(q not in s for s in data.values() for p in s for q in near(p, six))
    for up in range(levels):
        for fill in (True, False):
            cell = lambda s: {tuple(c >> up for c in p) for p in s}  # noqa: B023, E731
            full = lambda s: {o for o in cell(s) if sum(tuple(c >> up for c in p) == o for p in s) == 8**up}  # noqa: B023, E731
            got = {r["shape_id"]: r["n"] for r in grid.coarser(words, up, fill).groupBy("shape_id").agg(F.count("*").alias("n")).collect()}
            assert got == {i: len(cell(s) if fill else full(s)) for i, s in data.items() if (cell(s) if fill else full(s))}, (up, fill)


def test_spheres_of_any_radius(spark):
    atoms = spark.createDataFrame([(1, 8, 8, 8, 3.0), (2, 1, 15, 0, 4.5), (3, 5, 5, 5, 0.0), (4, 30, 3, 3, 2.0), (5, 3, 3, 3, None)], "shape_id long, gx int, gy int, gz int, r double")
    got = voxel_sets(shapes.to_words(shapes.sphere_voxels(atoms), 4), 4)
    ball = lambda c, r: {(x, y, z) for x in range(16) for y in range(16) for z in range(16) if (x - c[0]) ** 2 + (y - c[1]) ** 2 + (z - c[2]) ** 2 <= r * r}
    assert got == {1: ball((8, 8, 8), 3), 2: ball((1, 15, 0), 4.5), 3: {(5, 5, 5)}}


def test_empty_table(spark):
    none = shapes.to_words(spark.createDataFrame([], "shape_id long, x int, y int, z int"), 2)
    assert grid.grow(none, 2).count() == grid.shrink(none, 2).count() == search.packed(none).count() == 0


def test_octants_and_hausdorff(spark):
    words = shapes.to_words(golden(spark), 2)
    sizes = {(r["shape_id"], r["size"]): r["count"] for r in geo.octants(words, 2).groupBy("shape_id", "size").count().collect()}
    assert sizes == {(0, 4): 1, (1, 1): 1, (2, 2): 1, (3, 2): 4}
    every = geo.with_fields(spark.range(5).withColumnRenamed("id", "shape_id"), words, 2)
    corner = {r["shape_id"]: [(v % 5, v // 5 % 5, v // 25) for v in r["at"]] for r in every.collect()}
    assert corner[4] == [(2, 2, 2)]  # a shape without voxels
    far = lambda a, b: max(min(sum((p - q) ** 2 for p, q in zip(s, t)) for t in b) for s in a)
    for r in geo.hausdorff(every, every).collect():
        a, b = corner[r["query_id"]], corner[r["object_id"]]
        assert r["dist"] == max(far(a, b), far(b, a)) ** 0.5


def test_canonical_pose(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    atoms = [(m, a, *map(float, rng.normal(size=3) * (3, 2, 1) + 7), float(1 + a % 3)) for m in range(4) for a in range(9)]
    frame = spark.createDataFrame(atoms, "shape_id long, atom int, x double, y double, z double, mass double")
    got = geo.canonical_pose(frame).toPandas().sort_values(["shape_id", "atom"])
    for m in range(4):
        p, q = np.array([a[2:5] for a in atoms if a[0] == m]), got.loc[got.shape_id == m, ["x", "y", "z"]].to_numpy()
        w = np.array([a[5] for a in atoms if a[0] == m])
        assert np.allclose(w @ q, 0) and np.allclose(((p[:, None] - p) ** 2).sum(-1), ((q[:, None] - q) ** 2).sum(-1))
        second = (q * w[:, None]).T @ q
        assert np.allclose(second - np.diag(np.diag(second)), 0, atol=1e-8) and list(np.diag(second)) == sorted(np.diag(second), reverse=True)
        turn = np.linalg.lstsq(p - w @ p / w.sum(), q, rcond=None)[0]
        assert np.isclose(np.linalg.det(turn), 1)
        for axis in (0, 1):
            about = (q**2).sum(1) - q[:, axis] ** 2
            assert about[q[:, axis] < 0].sum() >= about[q[:, axis] >= 0].sum() - 1e-9


def test_interaction_points(spark):
    rows = [(1, k, float(k % 2), 0.0, 0.0) for k in range(4)] + [(1, 9, 30.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)]
    got = geo.interaction_points(spark.createDataFrame(rows, "shape_id long, atom int, x double, y double, z double")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 4, 0.5, 0.0, 0.0)]


def test_files(spark, tmp_path):
    words = shapes.to_words(golden(spark), 2)
    for r in files.to_voxel_files(words, 2, 0.5).collect():
        (tmp_path / f"{r['title']}.mira").write_bytes(r["content"])
    (tmp_path / "9.mira").write_bytes(b"no voxels")
    back = files.read_voxel_files(spark, str(tmp_path))
    assert {(r["side"], r["resolution"]) for r in back.collect()} == {(4, 0.5)}
    assert sorted(sum(bin(w["bits"] & (1 << 64) - 1).count("1") for w in r["words"]) for r in back.collect()) == [1, 8, 32, 64]
    text = {r["title"]: bytes(r["content"]).decode().split("\n") for r in files.export(words, 2, 0.5, ".grid").collect()}
    cells = {t: sum(map(int, " ".join(lines[4:]).split())) for t, lines in text.items()}
    assert sorted(cells.values()) == [1, 8, 32, 64] and text["1"][:4] == ["header", "4 4 4", "-1 -1 -1", "0.5 0.5 0.5"]
    mol = spark.createDataFrame([("a b", [(1.5, -2.0, 0.25, "Cl"), (0.0, 0.0, 10.0, "C")], [(1, 2, 1)], 0.75)], "title string, atoms array<struct<x: double, y: double, z: double, element: string>>, bonds array<struct<a: int, b: int, kind: int>>, score double")
    made = files.to_structures(mol, "score")
    (tmp_path / "m.sdf").write_text("".join(r["value"] + "$$$$\n" for r in made.collect()) * 2 + "junk\n$$$$\n")
    read = files.read_structures(spark, str(tmp_path / "m.sdf")).collect()
    want = mol.first()
    assert len(read) == 2 and all((r["title"], [tuple(a)[:4] for a in r["atoms"]], r["bonds"], r["props"]["score"]) == (want["title"], [tuple(a) for a in want["atoms"]], want["bonds"], "0.75") for r in read)


def test_clusters_take_all_members(spark, monkeypatch):
    """Copies, empty shapes, odd ids and a null label, in several blocks, against brute force."""
    monkeypatch.setattr(clusters, "BLOCK", 7)
    rng = __import__("random").Random(3)
    base = [0, 1, (1 << 63) | 5, *[rng.getrandbits(64) for _ in range(20)]]
    data = [(2 * i + 1, i % 3 if i % 11 else None, rng.choice(base[:4] if i % 2 else base)) for i in range(70)]
    table = spark.createDataFrame([(i, lab, b - (1 << 64) if b >> 63 else b) for i, lab, b in data], "shape_id long, label int, bits long")
    far = lambda a, b: 1.0 - (a & b).bit_count() / (a | b).bit_count() if a | b else 0.0
    want = {(i, o): w for i, _, a in data for w, o in sorted((far(a, b), o) for o, _, b in data if o != i)[:8]}
    assert {(r["src"], r["dst"]): r["weight"] for r in clusters.knn(table, 8).collect()} == want
    for r in clusters.linkage(table).collect():
        d = [far(a, b) for _, p, a in data for _, q, b in data if (p, q) == (r["query_label"], r["object_label"])]
        assert (r["single"], r["complete"]) == (min(d), max(d)) and abs(r["total"] - sum(d)) < 1e-9 and abs(r["average"] - sum(d) / len(d)) < 1e-12
    means = lambda lab: ((round(sum(far(a, b) for _, q, b in data if q == lab) / sum(q == lab for _, q, _ in data), 9), i) for i, p, a in data if p == lab)
    assert {r["label"]: (r["mean"], r["medoid"]) for r in clusters.medoids(table).collect()} == {lab: min(means(lab)) for lab in range(3)}


def test_pack_of_a_large_centre(spark, monkeypatch):
    """Leaves follow the order of the whole centre, whatever the number of its shapes and ties."""
    monkeypatch.setattr(index, "SORTED", 10)
    data = [(i * i, 1 << 60 if i % 3 == 0 else (1 << (i % 5 + 1)) - 1) for i in range(1, 200)]
    table = spark.createDataFrame([(i, 0, b) for i, b in data], "shape_id long, block int, bits long")
    packed = search.packed(table)
    got = {r["shape_id"]: (r["centre"], r["leaf"]) for r in index.pack(packed.where("shape_id = 1"), packed).collect()}
    own = dict(data)
    far = lambda b: 1.0 - (own[1] & b).bit_count() / (own[1] | b).bit_count()
    order = [i for _, i in sorted((far(b), i) for i, b in data)]
    assert got == {i: (1, k // index.LEAF) for k, i in enumerate(order)}


def test_hausdorff_meets_blocks(spark, monkeypatch):
    """Pairs of several blocks are all made once, by matrices and not as rows of a cross join."""
    from octavox.operators import joins

    rng = np.random.default_rng(6)
    words = spark.createDataFrame([(i, 0, int(rng.integers(-(1 << 62), 1 << 62)) if i else 0) for i in range(60)], "shape_id long, block int, bits long")
    every = geo.with_fields(words, words, 2)
    at = {r["shape_id"]: np.stack([np.array(r["at"]) % 5, np.array(r["at"]) // 5 % 5, np.array(r["at"]) // 25], 1) for r in every.collect()}
    monkeypatch.setattr(joins, "BLOCK", 7)
    met = geo.hausdorff(every.where("shape_id % 4 = 0"), every)
    plan = met._jdf.queryExecution().executedPlan().toString()
    got = {(r["query_id"], r["object_id"]): r["dist"] for r in met.collect()}
    far = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(-1)
    want = {(q, s): max(far(at[q], at[s]).min(0).max(), far(at[q], at[s]).min(1).max()) ** 0.5 for q in range(0, 60, 4) for s in range(60)}
    assert got == want and met.count() == len(want)
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("strict", [False, True])
def test_interaction_points_of_many_ligands(spark, strict):
    """Clusters of many ligands against one at a time; no group of rows is sent to Python for each ligand."""
    rng = np.random.default_rng(12)
    rows_ = [(int(i), a, *map(int, rng.integers(0, 9, 3))) for i in range(80) for a in rng.permutation(int(rng.integers(1, 9))).tolist()]
    met = geo.interaction_points(spark.createDataFrame(rows_, "shape_id long, atom int, x int, y int, z int").repartition(5), strict=strict)
    want = []
    for i in range(80):
        p = np.array([r[2:] for r in sorted(rows_) if r[0] == i], float)
        close = ((p[:, None] - p[None]) ** 2).sum(-1) <= 16
        free, k = set(range(len(p))), 0
        for a in sorted(range(len(p)), key=lambda a: close[a].sum()):
            if a not in free:
                continue
            own = [a]
            for b in sorted(free):
                if b != a and close[own, b].all():
                    own.append(b)
            free -= set(own if strict else own[1:])
            if len(own) >= 3:
                want.append((i, k, len(own), *p[own].mean(0).tolist()))
                k += 1
    assert sorted(map(tuple, met.collect())) == want and len(want) > 10
    assert "Grouped" not in met._jdf.queryExecution().executedPlan().toString() and "FlatMapGroups" not in met._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["auc_table", "shape_diff", "nn_small_big", "metric_abs_volume", "nn_threshold", "contains"])
def test_pairs_stay_where_they_are_made(spark, name):
    """Pairs of words are plain arithmetic, without lambdas, and aren't joined with their ends again, nor made unique, by a shuffle."""
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "map_entries" not in plan
    assert plan.count("Join") == 1 and "explode(ranks" not in plan
