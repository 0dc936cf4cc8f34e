from loreforge.sources import scratch


def test_sweep_takes_old_tables_only(spark, tmp_path, monkeypatch):
    import os
    import time

    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    root = tmp_path / "loreforge"
    for name in ("step-old", "step-new", "text-index"):
        (root / name).mkdir(parents=True)
    for name in ("step-old", "text-index"):
        os.utime(root / name, (time.time() - 90_000,) * 2)
    assert scratch.sweep(spark) == 1
    assert sorted(p.name for p in root.iterdir()) == ["step-new", "text-index"]
    assert scratch.sweep(spark) == 0
