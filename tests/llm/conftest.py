import numpy as np
import pytest


@pytest.fixture(scope="session")
def words():
    """Invented words by a fixed seed."""
    random = np.random.default_rng(5)
    letters = list("aeioulnrst")
    return ["".join(random.choice(letters, random.integers(2, 9))) for _ in range(400)]
