import pytest

from veritrail.sources.commits import Commits


def test_commits_are_kept_and_never_overwritten(spark, tmp_path):
    one = Commits(spark, str(tmp_path / "t"))
    assert one.all() == []
    for n in range(12):
        one.add(n, {"n": n, "name": "ä"})
    assert [e["n"] for e in Commits(spark, f"file://{tmp_path}/t").all()] == list(range(12))
    with pytest.raises(FileExistsError):
        Commits(spark, f"file://{tmp_path}/t").add(3, {"n": 99})
    assert one.all()[3] == {"n": 3, "name": "ä"} and len(one.all()) == 12
    # what a lost run left is no commit
    (tmp_path / "t/commits/.00000012-x").write_text("{")
    assert len(one.all()) == 12
