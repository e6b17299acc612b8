from helixframe import cli


def test_literals(spark, capsys):
    cli.run(spark, ["rc", "ATG"])
    cli.run(spark, ["translate", "TCTTGAAGG", "-c"])
    cli.run(spark, ["translate", "ATGTCTTGAAGG"])
    assert capsys.readouterr().out.split() == ["CAT", "S*R", "MS"]


def test_files(spark, tmp_path, capsys):
    a = tmp_path / "a.fasta"
    a.write_text(">x\nACGT\n>y\nGG\n>x\nTT\n")
    cli.run(spark, ["cat", str(a), str(a), "-fo", "fasta"])
    assert capsys.readouterr().out.count(">") == 6
    cli.run(spark, ["merge", str(a)])
    assert "ACGTTT" in capsys.readouterr().out
    cli.run(spark, ["print", str(a)])
    assert "3 sequences" in capsys.readouterr().out
    cli.run(spark, ["index", "create", str(tmp_path / "i"), str(a)])
    cli.run(spark, ["index", "fetch", str(tmp_path / "i"), "y", "x,1,3"])
    assert "GG" in capsys.readouterr().out
