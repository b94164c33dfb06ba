import pytest

pytest.importorskip("driftwalk.llm")
