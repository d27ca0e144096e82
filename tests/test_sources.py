import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.structure import angles, append_tag, formula, lengths, virial, volume
from framelake.operators.selection import State
from framelake.sources import formats, results, sinks, tables
from framelake.sources.formats import FormatError
from framelake.sources.formats import extxyz as parse_extxyz
from framelake.sources.formats import lammps as parse_lammps
from framelake.sources.npy import read_npy, write_npy
from framelake.sources.structures import Format, import_structures, read_extxyz, read_lammps, read_out, read_structures, register_format, with_ids, write_extxyz, write_single

XYZ = """3
Lattice="4 0 0 0 5 0 0 0 6" Properties=species:S:1:pos:R:3:force:R:3 energy=-3.25 pbc="T T F" Config_type="bulk|scf" note=hello
C 0 0 0 0.1 0 0
H 1 0 0 0 0.2 0
H 0 1 0.5 0 0 -0.3

1
energy=1e-3
Fe 0 0 0
"""
DUMP = """ITEM: TIMESTEP
7
ITEM: NUMBER OF ATOMS
2
ITEM: BOX BOUNDS xy xz yz pp pp ff
0 12 2
0 10 0
0 10 0
ITEM: ATOMS id type xs ys zs
2 2 0.5 0.5 0.5
1 1 0 0 0
"""


def test_round_trip(spark, tmp_path):
    (tmp_path / "a.xyz").write_text(XYZ)
    df = read_extxyz(spark, str(tmp_path / "a.xyz"))
    rows = df.orderBy("frame").collect()
    assert [(r.natoms, r.energy, r.config_type, r.pbc) for r in rows] == [(3, -3.25, "bulk|scf", [True, True, False]), (1, 1e-3, None, [True] * 3)]
    assert rows[0].extra == {"note": "hello"} and rows[0].forces[2] == [0, 0, -0.3] and rows[1].lattice is None
    write_extxyz(df, str(tmp_path / "out"))
    again = read_extxyz(spark, str(tmp_path / "out")).orderBy("natoms", ascending=False).collect()
    same = ("natoms", "species", "pos", "forces", "lattice", "pbc", "energy", "config_type")
    assert [[r[c] for c in same] for r in again] == [[r[c] for c in same] for r in rows]


@pytest.mark.parametrize("text", ["x\n\nFe 0 0 0", "2\n\nFe 0 0 0\n", "1\n\nFe 0 nan 0\n", '1\nLattice="1 2"\nFe 0 0 0\n', '1\npbc="T X F"\nFe 0 0 0\n', "1\nProperties=pos:R:3\n0 0 0\n"])
def test_malformed_frames_fail(text):
    with pytest.raises(FormatError):
        list(parse_extxyz(iter(text.splitlines())))


def test_lammps(spark, tmp_path):
    (frame,) = parse_lammps(iter(DUMP.splitlines()), {1: "Fe", 2: "O"})
    assert frame["species"] == ["Fe", "O"] and frame["lattice"] == [[10, 0, 0], [2, 10, 0], [0, 0, 10]] and frame["pos"][1] == [6, 5, 5] and frame["pbc"] == [True, True, False]
    (tmp_path / "d.lammpstrj").write_text(DUMP)
    assert read_lammps(spark, str(tmp_path / "d.lammpstrj")).first().species == ["X1", "X2"]


def test_out_tables_keep_file_order(spark, tmp_path):
    (tmp_path / "energy.out").write_text(" 1.5 2\n3 -4e-2\n")
    assert [tuple(r) for r in read_out(spark, str(tmp_path / "energy.out")).orderBy("row").collect()] == [(0, [1.5, 2.0]), (1, [3.0, -0.04])]


def test_structure_columns(spark):
    df = spark.createDataFrame([(["O", "H", "Fe", "C", "H"], [[3.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 3.0, 3.0]], [1.0, 2.0])], "s array<string>, l array<array<double>>, t array<double>")
    r = df.select(formula(F.col("s")).alias("f"), volume(F.col("l")).alias("v"), lengths(F.col("l")).alias("abc"), angles(F.col("l")).alias("ang"), virial(F.lit(None).cast("array<double>"), F.col("t"), F.col("l")).alias("w"), append_tag(F.lit("a|b"), "c").alias("tag")).first()
    assert (r.f, r.v, r.tag) == ("CH2OFe", 36.0, "a|b|c") and r.w == [-36.0, -72.0]
    assert np.allclose(r.abc, [3, 4, 18**0.5]) and np.allclose(r.ang, [45, 90, 90])


def test_long_tag_lists_keep_first_and_last(spark):
    one = lambda tags, tag, limit: spark.range(1).select(append_tag(F.lit(tags), tag, limit).alias("t")).first().t
    long = " ".join(f"tag{i:03}" for i in range(60))
    assert one(long, "new", 200) == "tag000|...+59|new"
    assert one("a" * 8 + " b", "c" * 30, 20) == "aaaaaaaa|...+1|ccccc"
    assert one("a", "c" * 30, 10) == "a|cccccccc" and one("a b", "b", 10) == "a|b" and one("a 'b'", "x|\" y", 0) == "a|b|x_y" and one("a", " ", 9) == "a" and one(None, "x" * 9, 4) == "xxxx"
    assert one(long, "new", 0) == long.replace(" ", "|") + "|new"


MANY = "".join(f'2\nLattice="4 0 0 0 4 0 0 0 4" Properties=species:S:1:pos:R:3:charge:R:1:move_mask:L:3:grp:S:1:spin:R:3 energy={i} tag="q \\"x\\""\nFe 0 0 {i} 0.5 T F T A 0 0 1\nO 1 1 1 -0.5 F F F B 0 0 -1\n' for i in range(300))


def test_files_are_split_at_frames_and_keep_every_column(spark, tmp_path):
    (tmp_path / "many.xyz").write_text(MANY)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        df = read_extxyz(spark, str(tmp_path / "many.xyz"))
        rows = df.orderBy("frame").collect()
        out = read_out(spark, str(tmp_path / "many.xyz")).orderBy("row").select("row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.frame, r.energy, r.pos[0][2]) for r in rows] == [(i, i, i) for i in range(300)]
    r = rows[7]
    assert r.props == {"charge": [[0.5], [-0.5]], "move_mask": [[1, 0, 1], [0, 0, 0]]} and r.labels == {"grp": ["A", "B"]} and r.spin == [[0, 0, 1], [0, 0, -1]] and r.extra == {"tag": 'q "x"'}
    assert [x.row for x in out] == list(range(1200)) and tables.count_frames(spark, str(tmp_path / "many.xyz")) == 300


def test_other_formats(spark, tmp_path):
    direct = "t\n2.0\n1 0 0\n0 1 0\n0 0 1\nFe O\n1 1\nDirect configuration= 1\n0 0 0\n.5 .5 .5\nDirect configuration= 2\n0 0 0\n.5 .5 .25\n"
    a, b = formats.xdatcar(iter(direct.splitlines()))
    assert a["pos"][1] == [1, 1, 1] and b["pos"][1] == [1, 1, 0.5] and b["species"] == ["Fe", "O"] and b["config_type"] == "XDATCAR_2"
    old = direct.replace("Fe O\n", "")
    assert [f["species"] for f in formats.xdatcar(iter(old.splitlines()))][0] == ["X1", "X2"] and next(formats.xdatcar(iter(old.splitlines()), ["A", "B"]))["species"] == ["A", "B"]
    block = "  in kB      10 20 30 1 2 3\n direct lattice vectors  reciprocal\n 2 0 0 1 1 1\n 0 2 0 1 1 1\n 0 0 2 1 1 1\n POSITION         TOTAL-FORCE (eV/Angst)\n ----\n 0 0 0 0.1 0 0\n 1 1 1 -0.1 0 0\n ----\n free  energy   TOTEN  =   -7.5 eV\n"
    text = "   VRHFIN =Fe: d\n   VRHFIN =O: s\n   ions per type =  1 1\n" + block + block.replace("-7.5", "-8.0")
    one, two = formats.outcar(iter(text.splitlines()))
    assert (one["energy"], two["energy"]) == (-7.5, -8.0) and one["forces"][0] == [0.1, 0, 0] and one["species"] == ["Fe", "O"]
    assert np.isclose(one["stress"][0], -1 / formats.GPA) and np.isclose(one["virial"][0], 8 / formats.GPA) and np.isclose(one["stress"][1], -0.1 / formats.GPA)
    cell = "".join(f" CELL| Vector {v} [angstrom]:   {c}   |{v}| = 5\n" for v, c in zip("abc", ("5 0 0", "0 5 0", "0 0 5")))
    body = " MODULE QUICKSTEP: ATOMIC COORDINATES IN ANGSTROM\n\n Atom Kind Element X Y Z Z(eff) Mass\n\n 1 1 Fe 26 0 0 0 16 55.8\n 2 2 O 8 1 1 1 6 16\n\n"
    force = " ATOMIC FORCES in [a.u.]\n\n # Atom Kind Element X Y Z\n 1 1 Fe 0.1 0 0\n 2 2 O -0.1 0 0\n SUM OF ATOMIC FORCES 0 0 0 0\n"
    c = next(formats.cp2k(iter((cell + body + " ENERGY| Total FORCE_EVAL ( QS ) energy [a.u.]: -2.0\n" + force).splitlines())))
    assert np.isclose(c["energy"], -2 * formats.HARTREE) and np.isclose(c["forces"][0][0], 0.1 * formats.HARTREE / formats.BOHR) and c["pos"][1] == [1, 1, 1]
    for bad in (cell.replace("Vector c", "Vector d") + body, cell + body + body, cell + body + force.replace(" 2 2 O -0.1 0 0\n", "")):
        with pytest.raises(FormatError):
            list(formats.cp2k(iter(bad.splitlines())))
    n = "begin\ncomment x y\nlattice 10 0 0\nlattice 0 10 0\nlattice 0 0 10\natom 1 0 0 H 0.2 0.5 1 0 0\nenergy -1\ncharge 0\nend\nbegin\natom 1 0 0 H 0 0 0 0 0\nend\n"
    (tmp_path / "input.data").write_text(n)
    p, q = read_structures(spark, str(tmp_path / "input.data")).orderBy("frame").collect()
    assert np.isclose(p.pos[0][0], 0.529177) and np.isclose(p.energy, -27.2114, atol=1e-3) and p.props["charge"] == [[0.2]] and p.pbc == [True] * 3 and q.pbc == [False] * 3
    spin = DUMP.replace("id type xs ys zs", "id type x y z c_spin[1] c_spin[2] c_spin[3] c_spin[4]").replace("2 2 0.5 0.5 0.5", "2 2 5 5 5 0 0 1 2.5").replace("1 1 0 0 0", "1 1 0 0 0 1 0 0 2")
    assert next(parse_lammps(iter(spin.splitlines())))["spin"] == [[2, 0, 0], [0, 0, 2.5]]


def test_registry_of_formats(spark, tmp_path):
    (tmp_path / "a.weird").write_text(XYZ)
    assert import_structures(spark, str(tmp_path / "a.weird")).count() == 2
    (tmp_path / "empty.xyz").write_text("\n \n")
    assert import_structures(spark, str(tmp_path / "empty.xyz")).count() == 0 and read_extxyz(spark, str(tmp_path / "empty.xyz")).count() == 0
    (tmp_path / "bad.xyz").write_text("no structure\nat all\n")
    with pytest.raises(FormatError, match="extxyz.*lammps"):
        import_structures(spark, str(tmp_path / "bad.xyz"))
    with pytest.raises(ValueError):
        register_format(Format("extxyz", formats.extxyz, (".q",)))


def test_arrays_round_trip(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("".join(f'2\nLattice="4 0 0 0 4 0 0 0 4" Properties=species:S:1:pos:R:3:force:R:3 energy={i} virial="1 2 3 4 5 6 7 8 9" Config_type="sys{i % 2}/x"\nO 0 0 {i} 0 0 1\nFe 1 1 1 0 0 -1\n' for i in range(7)))
    df = with_ids(read_extxyz(spark, str(tmp_path / "a.xyz")))
    counts = {r.config_type: r.frames for r in write_npy(df, str(tmp_path / "npy"), set_size=2).collect()}
    assert counts == {"sys0/x": 4, "sys1/x": 3}
    back = read_npy(spark, str(tmp_path / "npy"), order=["sys1/x"]).collect()
    key = lambda r: r["energy"]
    assert sorted(r.energy for r in back) == list(range(7)) and all(r.species == ["Fe", "O"] for r in back)
    by = {r.energy: r for r in back}
    assert by[3].pos == [[1, 1, 1], [0, 0, 3]] and by[3].forces[1] == [0, 0, 1] and by[3].config_type == "sys1/x" and by[3].source.startswith("00000000") and by[2].virial == list(range(1, 10)) and key(by[2]) == 2
    with pytest.raises(FormatError):
        write_npy(df.withColumn("energy", F.when(F.col("frame") > 1, F.col("energy"))), str(tmp_path / "npy"))
    assert read_npy(spark, str(tmp_path / "npy")).count() == 7  # what was there stays


def test_results_of_trainings(spark, tmp_path):
    (tmp_path / "train.xyz").write_text("".join(f'{n}\nLattice="4 0 0 0 4 0 0 0 4" energy={i}\n' + "".join(f"Fe {k} 0 0\n" for k in range(n)) for i, n in enumerate((2, 3))))
    (tmp_path / "nep.txt").write_text("nep4 1 Fe\ncutoff 5 4 10 10\n")
    (tmp_path / "energy_train.out").write_text("1.0 1.5\n2.0 nan\n")
    (tmp_path / "force_train.out").write_text("".join(f"{i} 0 0 0 0 0\n" for i in range(5)))
    (tmp_path / "descriptor_train.out").write_text("".join(f"{i} 1\n" for i in range(5)))
    got = results.load_results(spark, str(tmp_path / "train.xyz"))
    m = {(r.dataset, r.structure_id, r.row_no): (r.pred, r.ref) for r in got.metrics.collect()}
    assert m["energy", 0, 0] == ([1.0], [1.5]) and m["energy", 1, 0] == ([2.0], [2.0]) and m["force", 1, 2] == ([4.0, 0.0, 0.0], [0.0, 0.0, 0.0]) and "virial" in got.missing
    assert {r.structure_id: r.vec for r in got.descriptors.collect()} == {0: [0.5, 1.0], 1: [3.0, 1.0]}
    (tmp_path / "force_train.out").write_text("0 0 0 0 0 0\n")
    with pytest.raises(ValueError):
        results.load_results(spark, str(tmp_path / "train.xyz"))
    results.write_predictions(got.metrics.where("dataset = 'energy'"), str(tmp_path / "pred"), "abc")
    assert results.read_predictions(spark, str(tmp_path / "pred"), "abc").count() == 2
    with pytest.raises(FormatError):
        results.read_predictions(spark, str(tmp_path / "pred"), "abd")


def test_results_inside_frames_and_of_folders(spark, tmp_path):
    frame = '1\nLattice="2 0 0 0 2 0 0 0 2" Properties=species:S:1:pos:R:3:force:R:3:TACE_forces:R:3:mforce:R:3:TACE_noncollinear_magnetic_forces:R:3 energy=-4 TACE_energy=-3 TACE_virials="1 0 0 0 2 0 0 0 3" virial="1 0 0 0 1 0 0 0 1"\nFe 0 0 0 1 0 0 2 0 0 0 0 1 0 0 3\n'
    (tmp_path / "p.xyz").write_text(frame * 2)
    m = {(r.dataset, r.structure_id): (r.pred, r.ref) for r in results.load_results(spark, str(tmp_path / "p.xyz")).metrics.collect()}
    assert m["energy", 1] == ([-3.0], [-4.0]) and m["force", 0] == ([2.0, 0, 0], [1.0, 0, 0]) and m["mforce", 0] == ([0, 0, 3.0], [0, 0, 1.0]) and m["virial", 0][0] == [1, 2, 3, 0, 0, 0]
    (tmp_path / "q.xyz").write_text(frame + frame.replace(":mforce:R:3", "").replace(" 0 0 1 0 0 3", " 0 0 3"))
    assert not results.load_results(spark, str(tmp_path / "q.xyz")).metrics.where("dataset = 'mforce'").count()
    d = tmp_path / "sys"
    write_npy(with_ids(read_extxyz(spark, str(tmp_path / "p.xyz"))).withColumn("config_type", F.lit("a")).select("structure_id", "species", "pos", "lattice", "pbc", "energy", "config_type"), str(d))
    (d / "detail.e_peratom.out").write_text("1 2\n3 4\n")
    (d / "detail.f.out").write_text("1 1 1 2 2 2\n3 3 3 4 4 4\n")
    r = {(x.dataset, x.structure_id): (x.pred, x.ref) for x in results.load_results(spark, str(d)).metrics.collect()}
    assert r["energy", 0] == ([2.0], [1.0]) and r["force", 1] == ([4.0] * 3, [3.0] * 3)


def test_sinks(spark, tmp_path):
    (tmp_path / "a.xyz").write_text(XYZ)
    base = with_ids(read_extxyz(spark, str(tmp_path / "a.xyz")))
    state = State(base).remove(base.where("natoms = 1").select("structure_id"))
    assert sinks.export(state, str(tmp_path / "active")) == 1 and sinks.export(state, str(tmp_path / "gone"), "removed") == 1
    write_single(base, str(tmp_path / "one.xyz"), digits=3, order=["structure_id"])
    assert (tmp_path / "one.xyz").read_text().splitlines()[2].startswith("C 0.000 0.000 0.000 0.100") and read_extxyz(spark, str(tmp_path / "one.xyz")).count() == 2
    vec = spark.createDataFrame([(0, [0.123456789, 1.0]), (1, [2.0, 3.0])], "structure_id bigint, vec array<double>")
    sinks.export_descriptors(vec, base.where("structure_id = 0"), str(tmp_path / "d"), base)
    assert [r[0] for r in spark.read.text(str(tmp_path / "d")).collect()] == ["0.123457\t1\t-3.25"]
    sinks.write_evidence(vec, str(tmp_path / "cache"), {"dataset": "x"})
    assert sinks.read_evidence(spark, str(tmp_path / "cache"), {"dataset": "x"}).count() == 2 and sinks.read_evidence(spark, str(tmp_path / "cache"), {"dataset": "y"}) is None
    page = sinks.report({"Rows <1>": spark.createDataFrame([("<b>", 1.5)], "a string, b double")})
    assert "&lt;b&gt;" in page and "Rows &lt;1&gt;" in page and "1.5" in page


def test_settings(spark, tmp_path):
    (tmp_path / "nep.in").write_text("type 2 Fe O # elements\nbatch = 500\n# batch 3\n\nlambda_1 0.1\n")
    s = tables.read_settings(spark, str(tmp_path / "nep.in"))
    assert s == {"type": "2 Fe O", "batch": "500", "lambda_1": "0.1"} and tables.full_batch(s, 400) and not tables.full_batch(s, 501)
