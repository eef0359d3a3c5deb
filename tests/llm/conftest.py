import zlib

import pytest

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def held():
    """Whether a doc_id is held out."""
    return lambda i: zlib.crc32(str(i).encode()) % 4 == 2
