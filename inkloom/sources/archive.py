"""ZIP archives: each member through the engine, one level deep."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib

from inkloom.model import ARCHIVE_BYTES, INCOMPLETE, MIB, SKIPPED, Hints, InputTooLarge, NestedArchive, Options, Result, ResultTooLarge, Unsupported, Warn, add_warnings
from inkloom.sources.ooxml import ENCRYPTED, MAX_ENTRIES, TooManyEntries, preflight, read_bounded

#: Limits of an archive's members. Fixed values.
MAX_CONVERTED, MEMBER_BYTES, TOTAL_BYTES, OUTPUT_BYTES = 64, 10 * MIB, 128 * MIB, 32 * MIB
MORE_NOTE = "\n[... additional archive members skipped ...]\n"
NESTED = "nested archives are not converted"


def silent(name: str, is_dir: bool) -> bool:
    """Members that are no content: folders, resource forks, dotfiles."""
    return is_dir or name.startswith("__MACOSX/") or posixpath.basename(name).startswith(".")


def nested(name: str) -> bool:
    return posixpath.splitext(posixpath.basename(name))[1].lower() == ".zip"


def section(name: str, markdown: str) -> str:
    return f"\n## File: {name}\n\n{markdown}\n"


def relocated(name: str, warnings: list[Warn]) -> list[Warn]:
    return [Warn(w.converter, w.code, f"{name}: {w.location}" if w.location else name, w.message) for w in warnings]


class _Output:
    """Sections up to the limit; passing it fails the archive as a whole, as any other error of its converter."""

    def __init__(self, limit: int):
        self.limit, self.size, self.parts = limit, 0, []

    def room(self, name: str) -> int:
        left = self.limit - self.size - len(section(name, "").encode())
        if left <= 0:
            raise ValueError(f"zip: output exceeds {self.limit}-byte limit")
        return left

    def add(self, text: str) -> None:
        self.size += len(text.encode("utf-8", "replace"))
        if self.size > self.limit:
            raise ValueError(f"zip: output exceeds {self.limit}-byte limit")
        self.parts.append(text)


def convert(data: bytes, options: Options, engine, inside_archive: bool = False) -> Result:
    if inside_archive:
        raise NestedArchive(NESTED)
    if len(data) > ARCHIVE_BYTES:
        raise InputTooLarge(f"zip archive is {len(data)} bytes; limit is {ARCHIVE_BYTES}")
    preflight(data)
    box = zipfile.ZipFile(io.BytesIO(data))
    infos = box.infolist()
    if len(infos) > MAX_ENTRIES:
        raise TooManyEntries(len(infos), MAX_ENTRIES)
    if any(i.flag_bits & ENCRYPTED for i in infos):
        raise ValueError("zip: encrypted archives are not supported")
    out = _Output(min(OUTPUT_BYTES, options.max_result or OUTPUT_BYTES))
    warnings: list[Warn] = []
    converted = used = 0
    for info in infos:
        name = info.filename
        if silent(name, info.is_dir()):
            continue
        if nested(name):
            add_warnings(warnings, [Warn("zip", SKIPPED, name, NESTED)])
            continue
        if converted >= MAX_CONVERTED:
            out.add(MORE_NOTE)
            add_warnings(warnings, [Warn("zip", SKIPPED, "", f"archive holds more than {MAX_CONVERTED} convertible members")])
            break
        left = TOTAL_BYTES - used
        failure = body = None
        if info.file_size > MEMBER_BYTES:
            failure = f"member exceeds {MEMBER_BYTES // MIB}MB uncompressed"
        elif info.file_size > left:
            raise ValueError(f"zip: members exceed the total budget ({TOTAL_BYTES // MIB}MB)")
        else:
            try:
                body = read_bounded(box, info, min(MEMBER_BYTES, left))
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError) as e:
                failure = str(e)
            else:
                used += len(body)
                if used > TOTAL_BYTES:
                    raise ValueError(f"zip: members exceed the total budget ({TOTAL_BYTES // MIB}MB)")
                if len(body) > MEMBER_BYTES:
                    failure = f"member exceeds {MEMBER_BYTES // MIB}MB uncompressed"
        if failure is not None:
            out.add(section(name, f"[skipped: {failure}]"))
            add_warnings(warnings, [Warn("zip", INCOMPLETE, name, failure)])
            converted += 1
            continue
        base = posixpath.basename(name)
        hints = Hints(extension=posixpath.splitext(base)[1].lower(), filename=base)
        room = out.room(name)
        try:
            res = engine.convert(body, hints, options.tightened(room), inside_archive=True)
        except (Unsupported, NestedArchive) as e:
            add_warnings(warnings, [Warn("zip", SKIPPED, name, str(e))])
            continue
        except ResultTooLarge as e:
            raise ValueError(f"zip: output exceeds {out.limit}-byte limit") from e
        except Exception as e:
            out.add(section(name, f"[conversion failed: {e}]"))
            add_warnings(warnings, [Warn("zip", INCOMPLETE, name, str(e))])
        else:
            out.add(section(name, res.markdown))
            add_warnings(warnings, relocated(name, res.warnings))
        converted += 1
    if not out.parts:
        raise ValueError("zip: no convertible files in archive")
    return Result("".join(out.parts), "", warnings)
