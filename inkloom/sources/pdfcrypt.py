"""Decryption of PDF streams that open with the empty user password: RC4 and AES-128."""

from __future__ import annotations

import functools
import hashlib
import struct

#: The padding of passwords. Fixed value.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s = list(range(256))
    j = 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    i = j = 0
    out = bytearray()
    for byte in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(byte ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _times(a: int, b: int) -> int:
    """Product in the field of AES."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@functools.cache
def _tables() -> tuple[list[int], list[int], list[list[int]]]:
    """Substitution, its inverse, and the multiples by 9, 11, 13 and 14, all from their rules."""
    sub = []
    for x in range(256):
        inverse = next((y for y in range(256) if _times(x, y) == 1), 0)
        bits = 0x63
        for shift in range(5):
            bits ^= (inverse << shift | inverse >> (8 - shift)) & 255
        sub.append(bits)
    back = [0] * 256
    for x, y in enumerate(sub):
        back[y] = x
    return sub, back, [[_times(x, k) for x in range(256)] for k in (14, 11, 13, 9)]


def _round_keys(key: bytes) -> list[bytes]:
    sub, _, _ = _tables()
    words = [list(key[i : i + 4]) for i in range(0, 16, 4)]
    factor = 1
    for i in range(4, 44):
        w = list(words[-1])
        if i % 4 == 0:
            w = [sub[b] for b in w[1:] + w[:1]]
            w[0] ^= factor
            factor = _times(factor, 2)
        words.append([a ^ b for a, b in zip(words[i - 4], w, strict=True)])
    return [bytes(b for w in words[i : i + 4] for b in w) for i in range(0, 44, 4)]


def aes_block(keys: list[bytes], block: bytes) -> bytes:
    """One block of 16 bytes decrypted."""
    _, back, (by14, by11, by13, by9) = _tables()
    state = [a ^ b for a, b in zip(block, keys[10], strict=True)]
    for n in range(9, -1, -1):
        state = [back[state[(i - 4 * (i % 4)) % 16]] ^ keys[n][i] for i in range(16)]
        if n:
            mixed = []
            for c in range(0, 16, 4):
                a, b, d, e = state[c : c + 4]
                mixed += [by14[a] ^ by11[b] ^ by13[d] ^ by9[e], by9[a] ^ by14[b] ^ by11[d] ^ by13[e], by13[a] ^ by9[b] ^ by14[d] ^ by11[e], by11[a] ^ by13[b] ^ by9[d] ^ by14[e]]
            state = mixed
    return bytes(state)


def aes(key: bytes, data: bytes) -> bytes:
    """CBC with the first block as initial vector and padding at the end."""
    keys, out = _round_keys(key), bytearray()
    for at in range(16, len(data) - 15, 16):
        out += bytes(a ^ b for a, b in zip(aes_block(keys, data[at : at + 16]), data[at - 16 : at], strict=True))
    return bytes(out[: -out[-1]]) if out and 1 <= out[-1] <= 16 else bytes(out)


class Cipher:
    """The key of a document and the decryption of its streams."""

    def __init__(self, info: dict, file_id: bytes):
        version, revision = info.get("V", 0), info.get("R", 0)
        size, self.is_aes, self.plain = info.get("Length", 40) // 8, False, False
        if info.get("Filter") != "Standard" or version not in (1, 2, 4):
            raise ValueError(f"pdf: encryption of version {version} is not supported")
        if version == 1:
            size = 5
        if version == 4:
            name = info.get("StmF", "Identity")
            method = (info.get("CF") or {}).get(name, {}).get("CFM", "None")
            size, self.is_aes, self.plain = 16, method == "AESV2", name == "Identity" or method == "None"
        seed = hashlib.md5(PAD + info["O"][:32] + struct.pack("<I", info["P"] & 0xFFFFFFFF) + file_id)
        if revision >= 4 and info.get("EncryptMetadata") is False:
            seed.update(b"\xff" * 4)
        key = seed.digest()
        for _ in range(50 if revision >= 3 else 0):
            key = hashlib.md5(key[:size]).digest()
        self.key = key[:size]
        if revision >= 3:
            check = hashlib.md5(PAD + file_id).digest()
            for i in range(20):
                check = rc4(bytes(b ^ i for b in self.key), check)
            ok = check == info["U"][:16]
        else:
            ok = rc4(self.key, PAD) == info["U"][:32]
        if not ok:
            raise ValueError("pdf: the file needs a password")

    def stream(self, number: int, generation: int, data: bytes) -> bytes:
        if self.plain:
            return data
        key = hashlib.md5(self.key + struct.pack("<I", number)[:3] + struct.pack("<H", generation) + (b"sAlT" if self.is_aes else b"")).digest()[: min(len(self.key) + 5, 16)]
        return aes(key, data) if self.is_aes else rc4(key, data)
