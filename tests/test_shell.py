import pytest

from cairnlake.__main__ import PASSPHRASE, main


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv(PASSPHRASE, "secret")
    source = tmp_path / "in"
    (source / "a").mkdir(parents=True)
    (source / "a" / "f").write_bytes(b"x" * 20)
    (source / "skip.log").write_bytes(b"no")
    settings = tmp_path / "settings.toml"
    settings.write_text(f'repository = "{tmp_path}/repo"\nexclude = ["*.log"]\n')

    def call(*args, code=0):
        assert main(["--settings", str(settings), *args], spark) == code
        return capsys.readouterr()

    assert "no repository" in call("list", code=1).err
    assert call("init").out.startswith("made ")
    first = call("backup", str(source)).out.strip()
    (source / "b").write_bytes(b"more")
    second = call("backup", str(source)).out.strip()
    assert [line.split()[0] for line in call("list").out.splitlines()] == [first, second]
    assert call("list", "latest").out.split() == ["a/", "a/f", "b"]
    got = dict(line.split() for line in call("restore", "latest", str(tmp_path / "out")).out.splitlines())
    assert (got["files"], got["dirs"], got["failed"]) == ("2", "1", "0") and (tmp_path / "out" / "a" / "f").read_bytes() == b"x" * 20
    assert "TARGET_EXISTS" in call("restore", first[:6], str(tmp_path / "out"), "--path", "a", code=1).err
    assert call("restore", first, str(tmp_path / "out"), "--path", "a", "--overwrite")
    assert "is not there" in call("restore", first, str(tmp_path / "out"), "--path", "zz", code=1).err
    got = dict(line.split() for line in call("prune", "--forget", second).out.splitlines()[1:])
    assert got["chunks_dead"] == "1"
    assert "ok                       True" in call("check", "--read-data", "--rebuild-index").out
    assert call("forget", first).out.strip() == first
    assert "no snapshot" in call("restore", "latest", str(tmp_path / "x"), code=1).err
    monkeypatch.setenv(PASSPHRASE, "other")
    assert "passphrase" in call("list", code=1).err
    with pytest.raises(SystemExit) as e:
        main(["nothing"], spark)
    assert e.value.code == 2
