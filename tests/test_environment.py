from seamline.config import environment


def test_environment_wins_and_odd_lines_say_nothing(tmp_path, monkeypatch):
    f = tmp_path / ".env"
    f.write_text("# A=0\n\nA = 'x=y'\nB=\"two\"\nA=later\nnothing\n  #C=1\nHELD=file\n", encoding="utf-8")
    for k in "AB":
        monkeypatch.delenv(k, raising=False)
    monkeypatch.setenv("HELD", "process")
    assert environment(str(f)) == {"A": "x=y", "B": "two", "HELD": "process"}
    assert environment(str(tmp_path / "none")) == {}
