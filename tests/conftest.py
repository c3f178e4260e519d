from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

BUNDLES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "bundles")


@pytest.fixture(scope="session")
def spark():
    from colloquy.session import build_session, checkpoint_dir

    s = build_session("local[*]", app="colloquy-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="colloquy-test-")


@pytest.fixture(scope="session")
def ingested(spark, tmp_path_factory):
    """The hand-made bundles ingested once: (result, expected, errors, out_dir)."""
    import reference_model
    from bundle_factory import make_bundles
    from colloquy.plans import ingest as ING

    root = str(tmp_path_factory.mktemp("bundles"))
    out = str(tmp_path_factory.mktemp("tables"))
    make_bundles(root)
    res = ING.ingest(spark, root, out)
    expected, errors = reference_model.run(root)
    return res, expected, errors, out
