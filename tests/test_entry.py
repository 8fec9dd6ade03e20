"""The entry point works with and without the optional folder."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["frame_idx", "det_idx", "seg_idx", "iou"]


@pytest.mark.parametrize("left_over", [False, True])
def test_import_without_the_optional_folder(tmp_path, left_over):
    shutil.copytree(f"{ROOT}/pitchgrid", tmp_path / "pitchgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if left_over:
        (tmp_path / "pitchgrid" / "llm" / "__pycache__").mkdir(parents=True)
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'iou_match' in q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_outside_imports_the_optional_folder():
    for folder, _, names in os.walk(f"{ROOT}/pitchgrid"):
        for name in names:
            path = os.path.join(folder, name)
            if name.endswith(".py") and "/llm/" not in path:
                assert "pitchgrid.llm" not in open(path).read(), path
