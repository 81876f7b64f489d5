"""The driver contract holds with and without the training-data subpackage."""

import sys

import __spark_entry__ as E
from tidewatch.plans import ORACLES, QUERIES


def test_registry_without_the_training_data_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(E.queries()) == set(QUERIES) and set(E.oracle_sql()) == set(ORACLES)


def test_every_oracle_has_its_query():
    assert set(E.oracle_sql()) <= set(E.queries()) and set(QUERIES) <= set(E.queries())


def test_entry(spark):
    assert len(E.entry(spark).columns) == 16


def test_checkpoint_folder_must_be_shared(spark, monkeypatch):
    import pytest
    from tidewatch import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())
