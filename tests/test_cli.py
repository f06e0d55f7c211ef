import uuid

from kelasflow.__main__ import main
from kelasflow.session import checkpoint_root
from tests.conftest import SF001


def test_list(capsys):
    assert main(["list"]) == 0
    assert "q25_assignment_progress" in capsys.readouterr().out


def test_run_to_parquet(spark):
    out = f"{checkpoint_root(spark)}/cli-{uuid.uuid4().hex}"
    assert main(["run", "q17_teacher_course_total", "--test-dir", SF001, "--out", out]) == 0
    assert spark.read.parquet(out).count() == 1
