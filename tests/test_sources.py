import gzip
import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from activepool.plans.extract import extract_top
from activepool.plans.retrospect import read_runs
from activepool.sources import files, text


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_library_delimiter_gz_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;smiles;x\n1;"C;""C";5\n2;N;6\n')
    with gzip.open(tmp_path / "b.csv.gz", "wt") as out:
        out.write("id;smiles;x\n3;O |c:1|;7\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv.gz")]
    got = text.read_library(spark, paths, delimiter=";", key_col=1, cxsmiles=True)
    assert rows(got) == [('C;"C',), ("N",), ("O",)]


def test_oracle_last_number_wins(spark, tmp_path):
    (tmp_path / "o.csv").write_text("k,v\na,1\nb,oops\na,2\nc,3e1\nb,4\nc,bad\n")
    got = text.read_oracle(spark, str(tmp_path / "o.csv"), maximize=False)
    assert rows(got) == [("a", -2.0), ("b", -4.0), ("c", -30.0)]


def test_scores_failures_and_last_row(spark, tmp_path):
    (tmp_path / "s.csv").write_text("smiles,score\na,1.5\nb,\na,\nc,2\n")
    got = text.read_scores(spark, str(tmp_path / "s.csv"))
    assert rows(got) == [("a", None), ("b", None), ("c", 2.0)]
    scored, failed = text.read_scores_and_failures(spark, str(tmp_path / "s.csv"))
    assert rows(scored) == [("a", 1.5), ("c", 2.0)] and rows(failed) == [("a",), ("b",)]


def test_training_table(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("smiles,note,y1,y2\nC,x,1,\nN,x,,\nO,x,2.5,3\n")
    got = text.read_training(spark, str(path), ignore_columns=["note"], skip_none_targets=True)
    assert rows(got) == [(["C"], [1.0, None]), (["O"], [2.5, 3.0])]
    assert text.read_training(spark, str(path), ignore_columns=["note"], max_data_size=2).count() == 2
    assert rows(text.read_keys(spark, str(path))) == [(["C"],), (["N"],), (["O"],)]


def test_external_results(spark, tmp_path):
    (tmp_path / "r.csv").write_text('title,score\n"""d0""",-7\nd1,3\nd1,-9\n')
    sent = spark.createDataFrame([("a", "d0"), ("b", "d1"), ("c", "d2")], "id string, ext_id string")
    read = lambda m: rows(text.read_external_results(sent, spark, str(tmp_path / "r.csv"), 0, 1, missing=m))
    assert read("null") == [("a", 7.0), ("b", 0.0), ("c", None)]
    assert read("zero") == [("a", 7.0), ("b", 0.0), ("c", 0.0)]


def test_config_round_trip(spark, tmp_path):
    path = files.write_config(spark, {"top_k": 5, "off": False, "none": None, "sizes": [1, 2]}, str(tmp_path / "c"))
    got = dict(rows(text.read_config(spark, path)))
    assert got == {"top-k": "5", "sizes": "[1, 2]"}
    assert text.config_map(text.read_config(spark, path)).first()["config"] == got


def test_audit_training(spark, tmp_path):
    def codes(content):
        path = tmp_path / f"{abs(hash(content))}.csv"
        path.write_text(content)
        return dict(rows(text.audit_training(spark, str(path), lambda c: c.rlike("^[CNO, ]+$"))))

    assert codes("smiles,y\nC,1\nN,\n") == {}
    assert codes('smiles,y\n"C, N",1\n"O",2\n') == {}
    assert codes("smiles,y\nC,x\nZ,1\nZ,2\n") == {"target_not_number": 1, "bad_key": 2}
    assert codes("smiles,y\nC,\nN,\n") == {"no_target": 2}
    assert codes("smiles,y\nC,1\nN,1,2\nO\n") == {"row_width": 2}
    assert codes("smiles,y\nC,1\nsmiles,y\n") == {"bad_key": 1, "target_not_number": 1}
    assert codes("C,1\nN,1\n") == {"header_is_key": 1}
    assert codes("smiles,y\n") == {"no_rows": 1}
    assert codes("smiles\nC\n") == {"no_targets_in_header": 1, "no_target": 1}
    assert codes("") == {"no_header": 1}


def test_keys_without_title_and_row_places(spark, tmp_path):
    path = tmp_path / "k.csv"
    path.write_text("C,N,1\nO,,2\n")
    assert rows(text.read_keys(spark, str(path), header=False, n_keys=2)) == [(["C", "N"],), (["O", ""],)]
    with pytest.raises(ValueError):
        text.read_keys(spark, str(path), ["a"], header=False)
    path.write_text("smiles,y\nC,\nN,2\nO,3\n")
    got = text.read_training(spark, str(path), skip_none_targets=True, with_row=True)
    features = spark.createDataFrame([(0, 10), (1, 11), (2, 12)], "row long, f int")
    assert rows(text.attach_features(got, features).select("row", "f")) == [(1, 11), (2, 12)]


def test_numpy_features(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype="float64").reshape(3, 2))
    np.savez(tmp_path / "b.npz", features=np.ones((1, 2)))
    got = rows(files.load_features(spark, str(tmp_path / "a.npy")).select("row", "features"))
    assert got == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    assert files.load_features(spark, str(tmp_path / "b.npz")).first()["features"] == [1.0, 1.0]
    with pytest.raises(ValueError):
        files.load_features(spark, "x.pkl")


def test_missing_descriptor_stops(spark):
    d = spark.createDataFrame([("a", "1,2,3", 1), ("a", "9", 2)], "key string, d string, o int")
    ok = spark.createDataFrame([("a", 2)], "key string, n int")
    assert files.keyed_descriptors(d, ok, ["d"], F.col("o"), "n").first()["d"] == [1.0, 2.0]
    bad = spark.createDataFrame([("z", 2)], "key string, n int")
    with pytest.raises(Exception, match="no descriptors for key z"):
        files.keyed_descriptors(d, bad, ["d"], F.col("o"), "n").collect()


def test_run_directory_orders_by_number(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "top_1_explored_iter_2.csv").write_text("smiles,score\na,1\n")
    (data / "top_2_explored_iter_10.csv").write_text("smiles,score\na,1\nb,\n")
    (data / "all_explored_final.csv").write_text("smiles,score\nz,1\n")
    got = rows(read_runs(spark, {"r": str(tmp_path)}).select("run_id", "iter", "id", "score"))
    assert got == [("r", 2, "a", 1.0), ("r", 10, "b", None)]


def test_prediction_rounds_count_from_one(spark):
    for bad in (0, 3):
        with pytest.raises(ValueError):
            files.read_predictions(spark, "nowhere", bad, n_iters=3)


def test_extract_best_rows(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "all_explored_final.csv").write_text("smiles,score\nC,9\nN,8\nO,\n")
    (tmp_path / "extended.csv").write_text("smiles,name,node_id,score\nC,l1,n1,9\nN,l2,n2,8\nO,l3,n2,\n")
    for node, names in {"n1": ["l1_a", "l9"], "n2": ["l2_a", "l2_b", "l3_a"], "n3": ["l1_x"]}.items():
        with tarfile.open(tmp_path / f"{node}.tar.gz", "w:gz") as tar:
            for name in names:
                info = tarfile.TarInfo(f"poses/{name}.sdf")
                info.size = 3
                tar.addfile(info, io.BytesIO(b"abc"))
    members, counts = extract_top(spark, str(tmp_path), 3)
    assert rows(members.select("node_id", "member")) == [
        ("n1", "poses/l1_a.sdf"), ("n2", "poses/l2_a.sdf"), ("n2", "poses/l2_b.sdf"),
    ]
    assert rows(counts) == [("n1", 1), ("n2", 2)]


def test_sorted_score_files_keep_their_order(spark, tmp_path):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).alias("score"))
    path = files.write_final_scores(df.repartition(5), str(tmp_path))
    got = files.read_ordered_scores(spark, path).orderBy("pos").collect()
    want = sorted(range(500), key=lambda i: (i % 3 == 0, -i))
    assert [int(r["id"]) for r in got] == want and got[0]["pos"] == 1


def test_the_order_of_paths_decides(spark, tmp_path):
    """Names sort against the order given; a folder, a file in it and a pattern may be named."""
    for name, value in (("a", 1), ("b", 2), ("c", 3)):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "scores.csv").write_text(f"smiles,score\nx,{value}\n{name},{value}\n")
    read = lambda *paths: {r["id"]: r["score"] for r in text.read_scores(spark, [f"{tmp_path}/{p}" for p in paths]).collect()}
    assert read("a", "b") == {"x": 2.0, "a": 1.0, "b": 2.0}
    assert read("b", "a") == {"x": 1.0, "a": 1.0, "b": 2.0}
    assert read("c/scores.csv", "b", "a/*.csv")["x"] == 1.0
    assert read("b", "c", "a", "b")["x"] == 2.0  # a path named again counts where it was named last
    assert {r["id"]: r["y"] for r in text.read_oracle(spark, [f"{tmp_path}/c", f"{tmp_path}/a"]).collect()}["x"] == 1.0
    single = {r["id"]: r["score"] for r in text.read_scores(spark, f"{tmp_path}/*").collect()}
    assert single["x"] == 3.0
