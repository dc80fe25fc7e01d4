from __future__ import annotations

import json

from kithlink.__main__ import main


def test_commands(spark, tmp_path, capsys):
    at = lambda n: str(tmp_path / n)
    main(["gen-sample", "--out", at("p.parquet"), "--truth", at("t.csv"), "--rows", "400", "--duplicate-rate", "0.2"])
    main(["init", at("p.parquet"), "--out", at("drafted.json")])
    assert json.loads((tmp_path / "drafted.json").read_text())["unique_id"] == "id"
    small = {"unique_id": "id", "columns": [{"name": n} for n in ("last_name", "phone", "postcode", "dob")], "blocking": [{"type": "exact_value", "column": "dob"}, {"type": "rare_value", "column": "phone"}]}
    small["comparisons"] = [{"columns": [n], "levels": [{"type": "null"}, {"type": "exact"}, {"type": "else"}]} for n in ("last_name", "phone", "postcode")]
    (tmp_path / "s.json").write_text(json.dumps(small))
    main(["estimate", "--schema", at("s.json"), "--out", at("m.json"), "--u-sample", "5000", "--no-tie-holdout", at("p.parquet")])
    main(["predict", "--schema", at("s.json"), "--model", at("m.json"), "--out", at("e.parquet"), "--threshold", "0", at("p.parquet")])
    main(["cluster", "--schema", at("s.json"), "--predictions", at("e.parquet"), "--out", at("c.parquet"), at("p.parquet")])
    assert spark.read.parquet(at("c.parquet")).columns == ["unique_id", "cluster_id", "cluster_size"] and spark.read.parquet(at("e.parquet")).count() > 20
    capsys.readouterr()
    main(["explain-blocking", "--schema", at("s.json"), at("p.parquet")])
    assert json.loads(capsys.readouterr().out)["sources"][0]["source"] == "dob exact_value"
    main(["search", "--schema", at("s.json"), "--model", at("m.json"), "--field", "phone=1", "--k", "2", at("p.parquet")])
    assert "match_weight" in capsys.readouterr().out
    main(["search", "--schema", at("s.json"), "--model", at("m.json"), "--field", "phone=1", "--k", "2", "--json", "--explain", at("p.parquet")])
    assert "phone_level" in json.loads(capsys.readouterr().out)[0]
    main(["explain", "--schema", at("s.json"), "--model", at("m.json"), "--predictions", at("e.parquet"), "--json", at("p.parquet")])
    assert len(json.loads(capsys.readouterr().out)) == spark.read.parquet(at("e.parquet")).count()
    (tmp_path / "rows.csv").write_text("row_a,row_b\n0,1\n2,5\n")
    main(["explain", "--schema", at("s.json"), "--model", at("m.json"), "--row-pairs", at("rows.csv"), "--json", at("p.parquet")])
    assert [(r["row_a"], r["row_b"]) for r in sorted(json.loads(capsys.readouterr().out), key=lambda r: r["row_a"])] == [(0, 1), (2, 5)]
    main(["predict", "--schema", at("s.json"), "--model", at("m.json"), "--plan", at("p.parquet")])
    assert json.loads(capsys.readouterr().out)["records"] == 400
    main(["gen-sample", "--out", at("a.parquet"), "--out-b", at("b.parquet"), "--rows", "100"])
    assert spark.read.parquet(at("a.parquet")).count() + spark.read.parquet(at("b.parquet")).count() == 100
