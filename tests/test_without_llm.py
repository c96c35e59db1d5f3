"""The rest of the library works where the language-model subpackage is missing."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_folders(tmp_path):
    """A copy without the two folders and the pipeline: everything imports, all its tests are found, and those of the operators and sources pass."""
    left_out = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "*.json", "*.md")
    rest = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != ROOT]
    copy, alone = tmp_path / "copy", os.environ | {"PYTHONPATH": os.pathsep.join(rest)}
    shutil.copytree(ROOT, copy, ignore=left_out)
    assert not (copy / "tessera" / "llm").exists() and not (copy / "tests" / "llm").exists()
    code = "import __spark_entry__ as e, bench; names = e.queries(); assert names and not [q for q in names if q.startswith('op') and q[2].isdigit()] and 'pipeline' not in names and set(e.oracle_sql()) <= set(names)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=alone, check=True)
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, env=alone, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout[-2000:]
    run = subprocess.run([sys.executable, "-m", "pytest", "tests/test_operators.py", "tests/test_sources.py", "-q", "-x", "-p", "no:cacheprovider"], cwd=copy, env=alone, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]


def test_nothing_outside_imports_it():
    inside = ROOT / "tessera" / "llm"
    for path in (ROOT / "tessera").rglob("*.py"):
        if inside not in path.parents:
            assert "tessera.llm" not in path.read_text(), path


def test_what_the_subpackage_lacks_is_an_error():
    code = "import sys; sys.modules['xxhash'] = None\ntry:\n    import __spark_entry__\nexcept ImportError:\n    sys.exit(0)\nsys.exit(1)"
    if (ROOT / "tessera" / "llm").exists():
        subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
