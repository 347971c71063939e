import hashlib
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from quillspark.sources import registry as G


def cap(name, **more):
    base = {"capability_id": name, "version": "1", "action": "find", "target_type": "place", "provider_binding": "mock_catalog", "consequentiality": "read", "confirmation_required": False, "execution_status": "mock_only", **{k: [] for k in G.LISTS}, "target_names": ["Bar"]}
    return base | more


def write(folder, name, **content):
    (folder / name).write_text(json.dumps(content))
    return folder / name


def child(folder, name, parent, **content):
    return write(folder, name, extends=parent, extends_sha256=hashlib.sha256((folder / parent).read_bytes()).hexdigest(), **content)


def test_chains_of_registries(spark, tmp_path):
    write(tmp_path, "a.json", version="1", capabilities=[cap("x"), cap("y", target_type="food")])
    child(tmp_path, "b.json", "a.json", version="2", capabilities=[cap("z", action="book", consequentiality="write", confirmation_required=True)])
    path = child(tmp_path, "c.json", "b.json", version="3", replace_capability=cap("x", aliases=["Pub"], required_slots=["fact.location"]))
    version, caps = G.load(path)
    assert version == "3" and [c["capability_id"] for c in caps] == ["x", "y", "z"] and caps[0]["aliases"] == ["pub"]
    rows = {r.capability: r for r in G.table(spark, caps).collect()}
    assert rows["x"].names == ["bar", "pub"] and rows["x"].required == ["fact.location"] and rows["z"].confirmation
    write(tmp_path, "a.json", version="1", capabilities=[cap("x")])
    with pytest.raises(ValueError, match="extends"):
        G.load(path)
    child(tmp_path, "d.json", "a.json", version="4", replace_capability=cap("q"))
    with pytest.raises(ValueError, match="no single q"):
        G.load(tmp_path / "d.json")


@pytest.mark.parametrize("bad", [{"extra": 1}, {"target_names": []}, {"target_names": ["*"]}, {"execution_status": "live"}, {"consequentiality": "x"}, {"required_slots": ["a"], "optional_slots": ["a"]}, {"confirmation_required": True}, {"aliases": [1]}])
def test_bad_capabilities_are_refused(bad):
    with pytest.raises(ValueError):
        G.checked(cap("x", **bad))


def test_the_entry_imports_without_a_session():
    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env={**os.environ, "PYTHONPATH": str(root)}, timeout=120)
