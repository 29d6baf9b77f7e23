import json

import pytest

from corpusloom.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", **{
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def record(i, content, role="assistant", ts=1_750_000_000_000, **more):
    return {"id": f"m{i}", "conversation_id": "c1", "title": f"t{i}", "timestamp": ts + i * 1000, "role": role,
            "content": content, **more}


@pytest.fixture()
def day_clean(tmp_path):
    folder = tmp_path / "days"
    folder.mkdir()
    rows = [record(1, "alpha\nbeta line"), record(2, "question?", role="user"),
            record(3, "gamma\n#### deep\nmore text"), record(4, "delta\nepsilon")]
    (folder / "2025-01-02.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return folder
