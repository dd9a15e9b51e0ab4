"""Blocks of token files: every stretch alone, checkpoints at their borders, damage."""

import numpy as np
import pytest

from pageloom.llm import token_file as tf

STRETCH = tf.LANES * tf.CHECK_STEPS


def _block(n, spread=500, seed=3):
    ids = (np.random.default_rng(seed).zipf(1.3, n) % spread).astype(np.int64) if n else np.zeros(0, np.int64)
    symbols, freqs = tf.frequencies(ids)
    return ids, symbols, freqs, tf.encode_block(ids, symbols, freqs)


@pytest.mark.parametrize("n", [1, 2, tf.LANES - 1, tf.LANES, tf.LANES + 1, STRETCH - 1, STRETCH, STRETCH + 1, 3 * STRETCH + 17])
@pytest.mark.parametrize("spread", [1, 500, 40_000])
def test_whole_block_and_each_stretch(n, spread):
    ids, symbols, freqs, block = _block(n, spread)
    assert freqs.min() >= 1 and freqs.sum() == 1 << tf.SCALE_BITS
    assert (tf.decode_block(block, symbols, freqs) == ids).all()
    stretch = min(n, tf.LANES) * tf.CHECK_STEPS
    # in any order: a stretch needs nothing of the others
    for k in reversed(range(-(-n // stretch))):
        assert (tf.decode_block(block, symbols, freqs, stretch=k) == ids[k * stretch:(k + 1) * stretch]).all()


def test_one_table_for_several_blocks():
    a, b = _block(5000, 50, 1)[0], _block(70_000, 900, 2)[0]
    symbols, freqs = tf.frequencies(np.concatenate([a, b]))
    for ids in (a, b):
        block = tf.encode_block(ids, symbols, freqs)
        assert (tf.decode_block(block, symbols, freqs, lookup=tf.slots(freqs)) == ids).all()


def test_damage_is_told():
    ids, symbols, freqs, block = _block(STRETCH + 5)
    for at in (0, 4, tf._HEAD.size, tf._HEAD.size + 4, len(block) // 2, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            tf.decode_block(bytes(broken), symbols, freqs)
        with pytest.raises(ValueError):
            tf.decode_block(bytes(broken), symbols, freqs, stretch=1)
    for cut in (0, 3, tf._HEAD.size - 1, tf._HEAD.size, len(block) - 1):
        with pytest.raises(ValueError):
            tf.decode_block(block[:cut], symbols, freqs)


def test_size_is_near_the_entropy():
    ids, symbols, freqs, block = _block(4 * STRETCH)
    share = np.bincount(ids)[symbols] / len(ids)
    bits = -(share * np.log2(share)).sum() * len(ids)
    states = 5 * (4 + 8 * tf.LANES)
    assert len(block) * 8 <= 1.02 * bits + 8 * (states + tf._HEAD.size)
