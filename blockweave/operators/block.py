"""One block: choose a predictor, parse, pick the smallest form; and back."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

from blockweave.operators import huffman, matching, predict, tokens
from blockweave.operators.errors import CodecError, refuse
from blockweave.operators.matching import Group

#: Fixed values of the format.
STORED, COMMANDS, CODED_COMMANDS, SPLIT, REFERENCE = range(5)
METHOD_NAMES = {STORED: "stored", COMMANDS: "commands", CODED_COMMANDS: "coded_commands", SPLIT: "split", REFERENCE: "reference"}
PREDICTOR_NAMES = {predict.NONE: "none", predict.DELTA: "delta", predict.XOR: "xor"}


class Block(NamedTuple):
    """A block as it stands in an archive."""

    method: int
    predictor: int
    original: int
    checksum: int
    payload: bytes


#: Blocks that are encoded together, and about how many bytes of them, so that arrays stay in the cache.
TOGETHER, TOGETHER_BYTES = 254, 1 << 18


def encode_all(blocks: list[bytes], smallest: bool = False) -> list[Block]:
    """The block of each piece of data, encoded in groups. The split form wins over plain commands
    whenever it is shorter; with ``smallest`` the shortest of all forms is taken."""
    out: list[Block] = []
    group: list[bytes] = []
    size = 0
    for data in blocks:
        if group and (size + len(data) > TOGETHER_BYTES or len(group) == TOGETHER):
            out += _encode_group(group, smallest)
            group, size = [], 0
        group.append(data)
        size += len(data)
    return out + _encode_group(group, smallest) if group else out


def _encode_group(blocks: list[bytes], smallest: bool) -> list[Block]:
    plain = Group.of([np.frombuffer(x, np.uint8) for x in blocks])
    predictors = predict.choices(plain)
    changed = predict.transformed(plain, predictors)
    parse = matching.parse(changed)
    sizes = tokens.command_sizes(parse).tolist()
    out = []
    splits = tokens.pack_split(tokens.split(changed, parse))
    for i, (data, predictor, split, size) in enumerate(zip(blocks, predictors.tolist(), splits, sizes, strict=True)):
        method, payload = SPLIT, split
        # plain commands are written out only where the split form does not win by their length
        if smallest or len(split) >= size:
            begin, end = int(changed.bounds[i]), int(changed.bounds[i + 1])
            commands = tokens.commands(changed.data[begin:end].tobytes(), parse.of(i, begin))
            coded = huffman.encode(commands, below=len(commands))
            forms = [(COMMANDS, commands)] + ([(CODED_COMMANDS, coded)] if coded is not None else []) + ([(SPLIT, split)] if smallest else [])
            method, payload = min(forms, key=lambda f: len(f[1]))
        if len(payload) >= len(data):
            out.append(Block(STORED, predict.NONE, len(data), zlib.crc32(data), data))
        else:
            out.append(Block(method, predictor, len(data), zlib.crc32(data), payload))
    return out


def encode(data: bytes, smallest: bool = False) -> Block:
    return encode_all([data], smallest)[0]


def _commands(block: Block) -> tokens.Expanded:
    if block.method == STORED:  # no commands
        return tokens.Expanded(block.payload, 0, 0, len(block.payload), 0, 0)
    if block.method == COMMANDS:
        return tokens.restore(tokens.read_commands(block.payload), block.original)
    if block.method == CODED_COMMANDS:
        return tokens.restore(tokens.read_commands(huffman.decode(block.payload, tokens.command_limit(block.original))), block.original)
    if block.method == SPLIT:
        return tokens.restore_split(tokens.unpack_split(block.payload, block.original), block.original)
    raise refuse("UnsupportedMethod", str(block.method))


def _checked(block: Block, found: tokens.Expanded) -> tokens.Expanded:
    if block.predictor != predict.NONE:
        found = found._replace(data=predict.inverse(np.frombuffer(found.data, np.uint8), block.predictor).tobytes())
    if zlib.crc32(found.data) != block.checksum:
        raise refuse("ChecksumMismatch")
    return found


def expand(block: Block) -> tokens.Expanded:
    """The bytes of a block that is no reference, checked against its checksum, and the commands that made them."""
    return _checked(block, _commands(block))


def expand_all(blocks: Iterable[Block]) -> Iterator[tokens.Expanded | CodecError]:
    """``expand`` of each block in order, or why it is refused; groups of blocks are decoded together."""
    group: list[Block] = []
    size = 0
    for block in blocks:
        if group and (size + block.original > TOGETHER_BYTES or len(group) == TOGETHER):
            yield from _expand_group(group)
            group, size = [], 0
        group.append(block)
        size += block.original
    yield from _expand_group(group)


def _expand_group(blocks: list[Block]) -> Iterator[tokens.Expanded | CodecError]:
    own = [i for i, b in enumerate(blocks) if b.method == SPLIT]
    quick: dict[int, tokens.Expanded] = {}
    if len(own) > 1:
        streams = tokens.unpack_all([blocks[i].payload for i in own], [blocks[i].original for i in own])
        sound = [(i, s) for i, s in zip(own, streams) if s is not None]
        found = tokens.restore_all([s for _, s in sound], [blocks[i].original for i, _ in sound])
        quick = dict(zip([i for i, _ in sound], found)) if found is not None else {}
    for i, block in enumerate(blocks):
        try:
            yield _checked(block, quick[i] if i in quick else _commands(block))
        except CodecError as e:
            yield e


def decode(block: Block) -> bytes:
    return expand(block).data
