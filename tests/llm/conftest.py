import pytest


@pytest.fixture(scope="session")
def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
