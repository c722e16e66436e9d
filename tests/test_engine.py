"""Packers, rounding, surfaces, databases, files and analytics against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from octavox.functions.ordered import before
from octavox.operators import clusters, database, evaluate, geometry, grid, index, molecules, packers, rounding, search
from octavox.sources import files, shapes


def voxel_sets(frame, levels):
    out = {}
    for r in shapes.to_voxels(frame, levels).collect():
        out.setdefault(r["shape_id"], set()).add((r["x"], r["y"], r["z"]))
    return out


def random_words(n, blocks=2, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, (n // 4 + 1, blocks), dtype=np.uint64)
    w = np.repeat(base, 4, 0)[:n]
    return w ^ (np.uint64(1) << rng.integers(0, 64, w.shape, dtype=np.uint64))


@pytest.mark.parametrize("name", sorted(packers.PACKERS))
@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 61])
def test_packers_cover_all_within_size(name, n):
    d = packers.distances(random_words(n))
    label = packers.PACKERS[name](d, 4)
    assert len(label) == n and np.bincount(label).max() <= 4 and set(label) == set(range(label.max() + 1))
    assert (label == packers.PACKERS[name](d, 4)).all()
    if n == 61:  # four near copies each belong together: far better than by chance
        same = label[:, None] == label
        assert d[same].mean() < 0.6 * d[~same].mean()
    assert (packers.PACKERS[name](np.zeros((9, 9)), 4) >= 0).all()


def test_greedy_takes_the_nearest_pair_first():
    d = np.array([[0, 5, 1, 9], [5, 0, 9, 2], [1, 9, 0, 9], [9, 2, 9, 0]], float)
    assert packers.greedy(d, 2).tolist() == packers.full_merge(d, 2).tolist() == packers.matching(d, 2).tolist() == [0, 1, 0, 1]
    # The nearest pair first leaves a bad second one; a matching exchanges the ends.
    d = np.array([[0, 1, 2, 9], [1, 0, 9, 2], [2, 9, 0, 50], [9, 2, 50, 0]], float)
    assert packers.greedy(d, 2).tolist() == [0, 0, 1, 1] and packers.matching(d, 2, 0).tolist() == [0, 1, 0, 1]
    assert sorted(map(sorted, packers.complete_linkage(d, 2))) == [[0, 1, 2], [3]] or len(packers.complete_linkage(d, 2)) == 2
    assert packers.medoids(np.abs(np.subtract.outer([0, 1, 2, 50, 51, 52], [0, 1, 2, 50, 51, 52])).astype(float), 2) == [1, 4]


def test_partition_and_prune(spark):
    w = random_words(300, 1, 3)
    w[:120] = w[0]  # equal shapes, more than a partition holds
    table = spark.createDataFrame([(i, 0, int(b)) for i, b in enumerate(w.view(np.int64)[:, 0])], "shape_id long, block int, bits long")
    packed = search.packed(table)
    placed = packers.partition(packed, limit=40)
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert sum(sizes) == 300 and max(sizes) <= 40
    leaves = packers.pack(placed, "matching", 8)
    assert leaves.count() == leaves.select("shape_id").distinct().count() == 300
    assert leaves.groupBy("part", "leaf").count().agg(F.max("count")).first()[0] <= 8
    nodes = index.packed_nodes(index.envelopes_of(leaves.withColumn("node_id", F.struct("part", "leaf")).select("shape_id", "node_id"), table))
    members = packed.join(leaves, "shape_id").withColumn("node_id", F.struct("part", "leaf")).drop("part", "leaf")
    q = packed.where("shape_id % 30 = 0")
    got = sorted(map(tuple, search.pruned_top_k(q, members, nodes, 5).select("query_id", "object_id", "rank").collect()))
    assert got == sorted(map(tuple, search.top_k(search.scored(q, packed), 5).select("query_id", "object_id", "rank").collect()))
    tree = index.tree(leaves, table, ["part", "leaf"], fan=4)
    top = tree.agg(F.max("level")).first()[0]
    assert tree.where(f"level = {top}").select("node").distinct().count() == 1
    assert index.tree(leaves, table, ["part", "leaf"], fan=4, drop_top=1).agg(F.max("level")).first()[0] == top - 1
    root = tree.where(f"level = {top}").first()
    assert root["n"] == 300 and root["msv"] == int(np.bitwise_or.reduce(w.view(np.int64)[:, 0])) and root["miv"] == int(np.bitwise_and.reduce(w.view(np.int64)[:, 0]))


def test_descent_finds_neighbours(spark):
    w = random_words(400, 1, 5)
    table = spark.createDataFrame([(i, int(b)) for i, b in enumerate(w.view(np.int64)[:, 0])], "shape_id long, bits long")
    exact, got = clusters.knn(table, 6).toPandas(), clusters.knn_descent(table, 6).toPandas()
    worst = exact.groupby("src").weight.max()
    assert len(got) == 2400 and (got.weight <= got.src.map(worst) + 1e-12).mean() >= 0.95
    assert clusters.knn_descent(table.limit(0), 6).count() == 0


def plain_round(trees, up):
    """Trees as nested lists: a leaf is an 8-tuple of booleans, as in the definition of joint rounding."""
    if all(isinstance(t, tuple) for t in trees):
        mixed = {t for t in trees if any(t) and not all(t)}
        if len(mixed) != 1 or any(all(t) if up else not any(t) for t in trees):
            return trees
        return [t if not any(t) else ((True,) * 8 if up else (False,) * 8) for t in trees]
    kids = [[(k,) * 8 for k in t] if isinstance(t, tuple) else t for t in trees]
    new = [plain_round([t[o] for t in kids], up) for o in range(8)]
    out = []
    for i, t in enumerate(trees):
        own = [new[o][i] for o in range(8)]
        out.append(t if isinstance(t, tuple) else tuple(all(k) for k in own) if all(isinstance(k, tuple) and len(set(k)) == 1 for k in own) else own)
    return out


def as_tree(cells):
    if len(cells) == 8:
        return tuple(bool(c) for c in cells)
    kids = [as_tree(cells[o * len(cells) // 8 : (o + 1) * len(cells) // 8]) for o in range(8)]
    return tuple(all(k) for k in kids) if all(isinstance(k, tuple) and len(set(k)) == 1 for k in kids) else kids


def as_cells(tree, n):
    return [c for o in range(8) for c in ([tree[o]] * (n // 8) if isinstance(tree, tuple) else as_cells(tree[o], n // 8))]


def test_joint_rounding_matches_recursion(spark):
    rng = np.random.default_rng(2)
    for levels in (1, 2, 3):
        for trial in range(40):
            cells = np.repeat(rng.random((3, 8**levels // 2 ** (trial % 4))) < (0.2, 0.5, 0.8)[trial % 3], 2 ** (trial % 4), 1)
            if trial % 2:
                cells[1] = cells[0]
            for up in (True, False):
                want = [as_cells(t, 8**levels) for t in plain_round([as_tree(c) for c in cells], up)]
                assert rounding.round_once(cells, levels, up).tolist() == want
    data = [(1, c, 0, int(m), int(m)) for c, m in ((1, 0b11), (2, 0b11))] + [(2, 5, 0, -1, -1)]
    got = {(r["node_id"], r["child"]): (r["miv"], r["msv"]) for r in rounding.round_siblings(spark.createDataFrame(data, "node_id long, child long, block int, miv long, msv long"), 2).collect()}
    assert got[2, 5] == (-1, -1) and (1, 1) in got and got[1, 1] == got[1, 2]


@pytest.mark.parametrize("cut", [3, 20, 100, 400])
@pytest.mark.parametrize("fill", [True, False])
def test_rounding_by_volume(spark, cut, fill):
    rng = random.Random(cut)
    cells = {1: [rng.random() < 0.4 for _ in range(4096)], 2: [b for _ in range(64) for b in [rng.random() < 0.5] * 64], 3: [b for _ in range(8) for b in [rng.random() < 0.5] * 512]}
    cells[2][5] = not cells[2][5]

    def plain(tree, n):
        vol = sum(as_cells(tree, n))
        if fill and n - vol < cut:
            return [True] * n
        if not fill and vol < cut:
            return [False] * n
        return as_cells(tree, n) if isinstance(tree, tuple) else [c for k in tree for c in plain(k, n // 8)]

    rows = [(i, b, int(np.packbits(own[64 * b : 64 * b + 64], bitorder="little").view(np.int64)[0])) for i, own in cells.items() for b in range(64)]
    words = spark.createDataFrame([r for r in rows if r[2]], "shape_id long, block int, bits long")
    got = {i: [False] * 4096 for i in cells}
    for r in rounding.rounded(words, 4, cut, fill).collect():
        got[r["shape_id"]][64 * r["block"] : 64 * r["block"] + 64] = [bool(r["bits"] >> k & 1) for k in range(64)]
    assert got == {i: plain(as_tree(own), 4096) for i, own in cells.items()}


def test_hausdorff_on_wide_grids(spark):
    rng = random.Random(4)
    cells = [(i, rng.randrange(32), rng.randrange(32), rng.randrange(32)) for i in range(4) for _ in range(20)]
    words = shapes.to_words(spark.createDataFrame(cells, "shape_id long, x int, y int, z int"), 5)
    every = geometry.with_fields(spark.range(4).withColumnRenamed("id", "shape_id"), words, 5)
    corner = {r["shape_id"]: [(v % 33, v // 33 % 33, v // 1089) for v in r["at"]] for r in every.collect()}
    far = lambda a, b: max(min(sum((p - q) ** 2 for p, q in zip(s, t)) for t in b) for s in a)
    for r in geometry.hausdorff(every, every).collect():
        a, b = corner[r["query_id"]], corner[r["object_id"]]
        assert r["dist"] == max(far(a, b), far(b, a)) ** 0.5


def test_surface_is_what_a_probe_cannot_reach(spark):
    """Against the definition: points that no probe centre free of all atoms comes within its radius of."""
    dim, res, probe = 16.0, 0.5, 1.0
    sets = {1: [(-1.7, 0.1, 0.0, 1.5), (1.6, 0.0, 0.2, 1.4)], 2: [(-1.5, -0.8, 0.0, 1.5), (1.5, -0.8, 0.1, 1.4), (0.0, 1.7, 0.0, 1.6)]}
    balls = spark.createDataFrame([(i, k, *p) for i, own in sets.items() for k, p in enumerate(own)], "shape_id long, atom int, x double, y double, z double, r double")
    got = voxel_sets(molecules.surface(balls, probe, dim, res), 5)
    axis = np.arange(-5, 5, 0.2)
    free = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), -1).reshape(-1, 3)
    for i, own in sets.items():
        c, r = np.array(own)[:, :3], np.array(own)[:, 3]
        centres = free[(((free[:, None] - c) ** 2).sum(-1) >= (r + probe) ** 2).all(1)]
        at = np.stack(np.meshgrid(*[np.arange(8, 24)] * 3, indexing="ij"), -1).reshape(-1, 3)
        pts = (at + 0.5) * res - dim / 2
        near = np.array([((centres - p) ** 2).sum(1).min() for p in pts]) ** 0.5
        mine = np.array([tuple(map(int, a)) in got[i] for a in at])
        assert not (mine & (near < probe - 0.2)).any()  # nothing that a probe reaches
        inside = near > probe + 0.25
        assert (mine[inside]).mean() > 0.97 and inside.sum() > 100
        atoms = (((pts[:, None] - c) ** 2).sum(-1) <= r**2).any(1)
        assert mine[atoms].all() and (mine & ~atoms).sum() > 0


def test_database_round_trip(spark, tmp_path):
    mols = spark.createDataFrame([(1, "a", [(0.0, 0.0, 0.0, "C"), (1.5, 0.0, 0.0, "O")]), (2, "b", [(0.0, 0.0, 0.0, "C")]), (3, "c", [(3.0, 3.0, 3.0, "N")])], "shape_id long, title string, atoms array<struct<x: double, y: double, z: double, element: string>>")
    path = str(tmp_path / "db")
    database.create_from_molecules(mols, path, 16.0, 0.5)
    objects, words, meta = database.load(spark, path)
    assert meta == {"dimension": 16.0, "resolution": 0.5, "total": 3}
    with pytest.raises(Exception, match="exists"):
        database.create_from_molecules(mols, path, 16.0, 0.5)
    with pytest.raises(ValueError, match="power of two"):
        database.create_from_molecules(mols, str(tmp_path / "no"), 15.0, 0.5)
    near = database.nearest(words.where("shape_id = 2"), words, 2).collect()
    assert [(r["object_id"], r["rank"]) for r in near] == [(2, 1), (1, 2)]
    assert [r["object_id"] for r in database.nearest(words.where("shape_id = 2"), words, 0, 0.9).collect()] == [2, 1]
    assert database.nearest(words.where("shape_id = 2"), words, 0).count() == 3
    assert [r["title"] for r in database.with_payload(database.nearest(words.where("shape_id = 2"), words, 2), objects).collect()] == ["a", "b"]
    found = lambda **k: {(r[0], r[1]) for r in database.constrained(words.where("shape_id = 2"), words, **k).collect()}
    assert found() == {(2, 1), (2, 2)} and found(big=words.where("shape_id = 2")) == {(2, 2)}
    assert found(forbidden=words.where("shape_id = 1").withColumn("shape_id", F.lit(2).cast("long"))) == set()
    levels = 5
    receptor = words.where("shape_id = 3").withColumn("shape_id", F.lit(2).cast("long"))
    assert {r["object_id"] for r in database.between(words.where("shape_id = 2"), receptor, words, levels, 0.5, 0.6, 0.6).collect()} == {1, 2}
    assert {r["object_id"] for r in database.between(words.where("shape_id = 2"), receptor, words, levels, 0.5, 9.0, 0.6).collect()} == {1, 2}
    for r in files.to_voxel_files(words, levels, 0.5).collect():
        (tmp_path / f"{r['title']}.mira").write_bytes(r["content"])
    database.create_from_voxel_files(spark, str(tmp_path), str(tmp_path / "vx"), 16.0, 0.5)
    assert sorted(map(len, voxel_sets(database.load(spark, str(tmp_path / "vx"))[1], levels).values())) == sorted(map(len, voxel_sets(words, levels).values()))
    assert {r["db"] for r in database.load_all(spark, [path, path])[1].select("db").distinct().collect()} == {path}


def test_voxel_file_bytes(spark):
    """The header byte by byte, as the format has it."""
    words = shapes.to_words(spark.createDataFrame([(7, 1, 2, 3)], "shape_id long, x int, y int, z int"), 2)
    content = bytes(files.to_voxel_files(words, 2, 0.5).first()["content"])
    assert content[:6] == b"VOXEL\x1a" and content[6:8] == b"\x01\x00" and content[8:14] == b"\0\x04\0\x04\0\x04" and content[14:16] == b"\0\0"
    assert int.from_bytes(content[16:20], "little") == 256 and int.from_bytes(content[20:24], "little") == 256 + 96
    assert content[24:40] == b"resolution = 0.5" and content[40:256] == bytes(216) and np.frombuffer(content, "<f8", 4, 256).tolist() == [0, 0.5, 1, 1.5]
    assert len(content) == 352 + 64 and content[352 + 16 * 1 + 4 * 2 + 3] == 255 and sum(content[352:]) == 255
    made = lambda **k: spark.createDataFrame([("f", bytearray(bytes(content[: (at := k.get("at", 0))]) + k.get("by", b"") + bytes(content[at + len(k.get("by", b"")) :])))], "title string, content binary")
    assert files.parse_voxels(made()).first()["resolution"] == 0.5
    assert files.parse_voxels(made(at=6, by=b"\x02\x00")).count() == 1  # other versions are read
    assert files.parse_voxels(made(at=14, by=b"\x01\x00")).count() == 0  # colours are not
    assert files.parse_voxels(made(at=8, by=b"\0\x05")).count() == 0
    assert files.parse_voxels(made(at=128, by=b"a text\0")).first()["text"] == "a text"


def test_grid_formats(spark):
    words = shapes.to_words(spark.createDataFrame([(7, 1, 2, 3), (7, 0, 0, 0)], "shape_id long, x int, y int, z int"), 2)
    get = lambda kind: bytes(files.export(words, 2, 0.5, kind).first()["content"])
    assert get(".raw") == bytes(255 if k in (0, 16 + 8 + 3) else 0 for k in range(64))
    text = get(".txt").decode().split("\n")
    assert text[:4] == ["header", "4 4 4", "-1 -1 -1", "0.5 0.5 0.5"] and text[4] == "1 0 0 0 " and text[8] == "" and text[9 + 2] == "0 0 0 1 "
    cells = get(".map").decode().split("\n")
    assert cells[:6] == ["GRID_PARAMETER_FILE", "GRID_DATA_FILE", "MACROMOLECULE", "SPACING 0.5", "NELEMENTS 3 3 3", "CENTER 0 0 0"] and [k for k, c in enumerate(cells[6:70]) if c == "1"] == [0, 3 * 16 + 2 * 4 + 1]
    table = get(".csv").decode().split("\n")
    assert table[0] == "4,4,4" and table[1].split(",")[0] == "#0000ffff" and table[1 + 2 * 5 + 1].split(",")[3] == "#0000ffff"


def test_structure_properties_and_hydrogens(spark, tmp_path):
    kinds = "title string, atoms array<struct<x: double, y: double, z: double, element: string, charge: int, iso: int>>, bonds array<struct<a: int, b: int, kind: int>>, props map<string,string>"
    atoms = [(float(k), 0.0, 0.0, "H" if k in (1, 11) else "C", k % 3 - 1, 13 if k == 4 else 0) for k in range(12)]
    mol = spark.createDataFrame([("m", atoms, [(1, 2, 1), (1, 3, 2), (3, 5, 1)], {"tag": "value"})], kinds)
    made = files.to_structures(mol).first()["value"]
    assert sum(line.startswith("M  CHG") for line in made.split("\n")) == 1 and "M  ISO  1   5  13" in made
    back = files.parse_structures(spark.createDataFrame([(made,)], "value string")).first()
    assert back["atoms"] == mol.first()["atoms"] and back["props"] == {"tag": "value"}
    heavy = files.parse_structures(spark.createDataFrame([(made,)], "value string"), False).first()
    assert len(heavy["atoms"]) == 10 and [tuple(b) for b in heavy["bonds"]] == [(1, 2, 2), (2, 4, 1)]
    many = spark.createDataFrame([("m", [(0.0, 0.0, 0.0, "C", 1, 0)] * 9, [], {})], kinds)
    assert sum(line.startswith("M  CHG") for line in files.to_structures(many).first()["value"].split("\n")) == 2
    (tmp_path / "p.pdb").write_text("HEADER x\nATOM      1  CA  ALA A   1      11.104   6.134  -6.504  1.00  0.00           C\nHETATM    2  H1  HOH A   2       1.000   2.000   3.000  1.00  0.00           H\nEND\n")
    p = files.read_protein(spark, str(tmp_path / "p.pdb")).first()
    assert [tuple(a) for a in p["atoms"]] == [(11.104, 6.134, -6.504, "C")]
    assert molecules.weight(mol.withColumn("shape_id", F.lit(1))).first()["weight"] == pytest.approx(9 * 12.011 + 13 + 2 * 1.008)


def test_jobs_and_lines(spark):
    jobs = files.parse_jobs(spark.createDataFrame([("NNSearch a.sdf 5\nDCSearch  l.sdf r.sdf 1 2\n\nNNSearch late 1",)], "value string")).collect()
    assert [(r["job"], r["command"], r["args"]) for r in jobs] == [(0, "NNSearch", ["a.sdf", "5"]), (1, "DCSearch", ["l.sdf", "r.sdf", "1", "2"])]
    hits = spark.createDataFrame([("t", 1, 1 / 3)], "title string, rank int, score double")
    assert files.score_lines(hits).first()["value"] == "t\t0.333333333333"
    assert files.ranked_lines(hits, "title").first()["value"] == "1\tt\t0.333333333333"


def test_pivots_are_chosen_farthest_first(spark):
    rng = random.Random(17)
    data = [(i, rng.getrandbits(63) & rng.getrandbits(63)) for i in range(3, 200)] + [(500, 0), (501, 0)]
    far = lambda a, b: 1.0 - (a & b).bit_count() / (a | b).bit_count() if a | b else 0.0
    want = [data[0][1]]
    while len(want) < 12:
        want.append(min((-min(far(b, p) for p in want), i, b) for i, b in data)[2])
    table = spark.createDataFrame(data, "shape_id long, bits long").repartition(4)
    assert clusters.farthest_first(table, 12) == want
    assert clusters.farthest_first(table.where("shape_id >= 500"), 12) == [0] and clusters.farthest_first(table.limit(0), 12) == []


def test_rounds_of_descent_get_smaller(spark):
    """Near groups and noise: old acquaintances are not joined again, and nearly all neighbours are found."""
    rng = random.Random(18)
    base = [rng.getrandbits(63) for _ in range(60)]
    data = [(i, base[i % 60] ^ sum(1 << rng.randrange(63) for _ in range(3)) if i % 3 else rng.getrandbits(63)) for i in range(1500)]
    table = spark.createDataFrame([(i, b & (1 << 63) - 1) for i, b in data], "shape_id long, bits long")
    joined = []
    got = clusters.knn_descent(table, 6, joined=joined).toPandas()
    exact = clusters.knn(table, 6).toPandas()
    assert joined[-1] < 0.5 * joined[0] and len(joined) >= 2
    assert len(got) == len(exact) and len(got.merge(exact, on=["src", "dst"])) >= 0.95 * len(exact)


def test_verbose_logs(spark):
    """Arguments are not times; marks carry over ranges of lines, within their file; the last Found time of a file counts."""
    log = ["Found 9 objects out of 9 in 7.5 s with 1 checks", "# DCPTS 2", "Batch NNSearch q 5 0.25 0.5", "Batch DCSearch l r 1 2 0.5", "noise", "Found 3 objects out of 10 in 0.25 s (0.1 objload) with 3 checks", " level 0: 1 1", "Found 3 objects out of 10 in 0.5 s (0.1 objload) with 3 checks"]
    log += ["# DCPTS 3", *["x"] * 40, "Found 1 objects out of 10 in 2 s with 3 checks", "Batch Other 1"]
    lines = [(f, i, v) for f in ("a", "b") for i, v in enumerate(log)] + [("c", 0, "Batch NNSearch q 5 1.5")]
    table = spark.createDataFrame(lines, "file string, line int, value string").repartition(7)
    got = sorted((r["line"], r["part"], r["kind"], r["text"], r["trial"], r["seconds"]) for r in evaluate.parse_log(table).where("file = 'b' and kind <> 'Found'").collect())
    assert got == [(2, 2, "NNSearch", "NNSearch q 5", 0, 0.25), (2, 2, "NNSearch", "NNSearch q 5", 1, 0.5), (3, 2, "DCSearch", "DCSearch l r 1 2", 0, 0.5), (50, 3, "Other", "Other", 0, 1.0)]
    assert evaluate.parse_log(table).where("file = 'c'").first()["part"] is None
    assert {r["part"]: r["seconds"] for r in evaluate.part_times(evaluate.parse_log(table)).collect()} == {None: 15.0, 2: 1.0, 3: 4.0}


def test_one_class(spark):
    scored = spark.createDataFrame([(1.0, True), (2.0, True)], "score double, positive boolean")
    assert evaluate.auc(scored).first()["auc"] is None
    assert {(r["fpr_limit"], r["partial"]) for r in evaluate.partial_auc(scored).collect()} == {(0.01, None), (0.05, None), (0.1, None)}


def test_unknown_elements_have_no_weight(spark):
    mol = spark.createDataFrame([(1, [("C",), ("Xx",)]), (2, [("C",), ("Fe",)])], "shape_id long, atoms array<struct<element: string>>")
    assert {r["shape_id"]: r["weight"] for r in molecules.weight(mol).collect()} == {1: None, 2: pytest.approx(12.011 + 55.845)}


def test_databases_keep_empty_shapes_and_refuse_foreign_files(spark, tmp_path):
    objects = spark.createDataFrame([(1, "full"), (2, "empty")], "shape_id long, title string")
    words = spark.createDataFrame([(1, 0, 7)], "shape_id long, block long, bits long")
    database.create(objects, words, str(tmp_path / "db"), 4.0, 1.0)
    own = database.load(spark, str(tmp_path / "db"))[1]
    near = sorted((r["object_id"], r["dist"]) for r in database.nearest(own.where("shape_id = 1"), own, 0).collect())
    assert near == [(1, 0.0), (2, 1.0)]
    none = own.where("shape_id = 2").withColumn("shape_id", F.lit(9).cast("long"))
    big = spark.createDataFrame([(9, 0, 3)], "shape_id long, block long, bits long")
    assert [tuple(r) for r in database.constrained(none, own, big).collect()] == [(9, 2)]
    assert {r["object_id"] for r in database.constrained(none, own).collect()} == {1, 2}
    cube = lambda side: spark.createDataFrame([(side, 0, 1)], "shape_id long, block long, bits long")
    for name, levels, resolution in (("same", 2, 0.5), ("coarse", 2, 2.0), ("large", 3, 0.5)):
        (tmp_path / name).mkdir()
        for file, lv, res in {("a", 2, 0.5), (name, levels, resolution)}:
            (tmp_path / name / f"{file}.mira").write_bytes(bytes(files.to_voxel_files(cube(1), lv, res).first()["content"]))
        if name == "same":
            database.create_from_voxel_files(spark, str(tmp_path / name), str(tmp_path / "ok"), 2.0, 0.5)
        else:
            with pytest.raises(ValueError):
                database.create_from_voxel_files(spark, str(tmp_path / name), str(tmp_path / f"bad_{name}"), 2.0, 0.5)


def test_truncation_follows_the_octree(spark):
    """Against a recursion over cubes of cells, at every cut and in both modes."""
    rng = np.random.default_rng(8)
    shapes_ = [rng.random((16, 16, 16)) < 0.02, np.ones((16, 16, 16), bool), np.zeros((16, 16, 16), bool)]
    mixed = np.zeros((16, 16, 16), bool)
    mixed[:8, :8, :8], mixed[8:12, :4, :4], mixed[8:10, 8:10, 8:10], mixed[0:2, 8:12, 8:10], mixed[15, 15, 15] = True, True, True, True, True
    shapes_ += [mixed, ~mixed]

    def cut_at(cube, cut, fill):
        side = len(cube)
        if side <= cut:
            return np.full_like(cube, fill and cube.any())
        half = side // 2
        eighths = [(slice(x, x + half), slice(y, y + half), slice(z, z + half)) for x in (0, half) for y in (0, half) for z in (0, half)]
        if all(cube[e].all() or not cube[e].any() for e in eighths):
            return cube
        out = cube.copy()
        for e in eighths:
            out[e] = cut_at(cube[e], cut, fill)
        return out

    def words_of(cube):
        out = {}
        for x, y, z in np.argwhere(cube).tolist():
            code = sum((x >> b & 1) << 3 * b | (y >> b & 1) << 3 * b + 1 | (z >> b & 1) << 3 * b + 2 for b in range(4))
            out[code >> 6] = out.get(code >> 6, 0) | 1 << (code & 63)
        return {k: v - (1 << 64) if v >> 63 else v for k, v in out.items()}

    table = spark.createDataFrame([(i, b, w) for i, c in enumerate(shapes_) for b, w in words_of(c).items()], "shape_id long, block long, bits long")
    for cut in (1, 2, 4, 8, 16):
        for fill in (False, True):
            got = {(r["shape_id"], r["block"]): r["bits"] for r in grid.truncated(table, 4, cut, fill).collect()}
            assert got == {(i, b): w for i, c in enumerate(shapes_) for b, w in words_of(cut_at(c, cut, fill)).items()}, (cut, fill)


def test_running_sums_over_ranges(spark):
    rng = random.Random(6)
    rows = [(i, rng.random(), rng.randrange(100)) for i in range(500)]
    got = before(spark.createDataFrame(rows, "id long, x double, v long"), [F.col("x")], {"s": "v"}, {"t": "v"}).collect()
    total, top = 0, None
    for r in sorted(got, key=lambda r: r["x"]):
        assert (r["s"], r["t"]) == (total, top)
        total, top = total + r["v"], max(top or 0, r["v"])
    assert len(got) == 500


def test_tail_and_bootstrap(spark):
    for hits, drawn, positives, total in ((0, 5, 3, 20), (2, 5, 3, 20), (3, 5, 3, 20), (7, 10, 8, 50), (1, 30, 25, 50), (30, 40, 35, 60), (5, 4, 9, 20)):
        ways = sum(math.comb(positives, k) * math.comb(total - positives, drawn - k) for k in range(hits, min(drawn, positives) + 1))
        assert evaluate.tail(hits, drawn, positives, total) == pytest.approx(ways / math.comb(total, drawn), rel=1e-9, abs=1e-12)
    counts = spark.createDataFrame([("a", 2, 5, 3, 20), ("b", 7, 10, 8, 50)], "search string, hits long, drawn long, positives long, total long")
    once, twice = (sorted(r["p_value"] for r in evaluate.enrichment(counts, n).collect()) for n in (1, None))
    assert twice == pytest.approx([min(1, 2 * p) for p in once])
    rng = np.random.default_rng(1)
    x = [(float(round(rng.normal(k % 2), 2)), bool(k % 2)) for k in range(400)]
    scored = spark.createDataFrame(x, "score double, positive boolean")
    low, high = evaluate.bootstrap_auc(scored).first()
    p, n = np.array([s for s, y in x if y]), np.array([s for s, y in x if not y])
    draws = []
    for _ in range(600):
        a, b = rng.choice(p, len(p)), rng.choice(n, len(n))
        draws.append(((a[:, None] > b) + 0.5 * (a[:, None] == b)).mean())
    assert abs(low - np.quantile(draws, 0.05)) < 0.01 and abs(high - np.quantile(draws, 0.95)) < 0.01
    assert tuple(evaluate.bootstrap_auc(scored.repartition(3)).first()) == (low, high)
