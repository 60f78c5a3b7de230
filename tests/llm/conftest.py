"""Folders of the given tables, the smallest first."""

import os

import pytest

TABLES = os.environ.get("DAFTAR_TABLES", "/root/testdata")


@pytest.fixture(scope="session")
def sf_middle():
    return f"{TABLES}/sf0.01"


@pytest.fixture(scope="session")
def sf_large():
    return f"{TABLES}/sf0.1"
