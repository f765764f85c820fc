"""The command line, operation by operation."""

from tidemark.__main__ import run


def test_operations(spark, tmp_path, capsys):
    path = str(tmp_path / "t")

    def out(*args):
        status = run(spark, [path, *args])
        return status, capsys.readouterr().out.strip()

    assert out("get", "a") == (1, "")
    first = int(out("put", "a", "1")[1])
    out("put", "b", "")
    out("put", "a", "2")
    assert out("get", "a") == (0, "2") and out("get", "a", "--at", str(first)) == (0, "1") and out("get", "b") == (0, "")
    assert out("scan", "a", "c")[1].splitlines()[0] == "a\t2"
    out("delete", "a")
    assert out("get", "a") == (1, "") and out("scan", "a", "b") == (0, "")
