"""What a Python worker keeps between tasks."""

from __future__ import annotations

from seqloom.llm import bpe
from seqloom.llm.queries import bpe_file


def test_a_waiting_worker_holds_the_model_only():
    """What a task remembered goes with it: pieces, seams, and the spines of tokens, which were kept."""
    model = bpe.PrefixBpe(bpe_file())
    piece = "uncharacteristically"
    ids = model.encode_piece(piece)
    model.piece(piece)
    assert model.spine.cache_info().currsize > 0 and model.seams
    model.forget()
    assert model.spine.cache_info().currsize == 0 and not model.seams and not model.pieces
    assert model.encode_piece(piece) == ids
