"""Mach-O headers: architecture, code-signing flags and entitlements. Never raises."""

from __future__ import annotations

import plistlib
import struct

#: CPU types and magic numbers (fixed values of the format).
CPUS = {7: "i386", 0x01000007: "x86_64", 12: "arm", 0x0100000C: "arm64", 18: "ppc", 0x01000012: "ppc64"}
SUBTYPES = {(0x0100000C, 2): "arm64e"}
THIN = {b"\xfe\xed\xfa\xce": (">", 28), b"\xce\xfa\xed\xfe": ("<", 28), b"\xfe\xed\xfa\xcf": (">", 32), b"\xcf\xfa\xed\xfe": ("<", 32)}
FAT = {b"\xca\xfe\xba\xbe": 20, b"\xca\xfe\xba\xbf": 32}
SIGNATURE, SUPERBLOB, DIRECTORY, ENTITLEMENTS = 0x1D, 0xFADE0CC0, 0xFADE0C02, 0xFADE7171
MOST_SLICES, MOST_COMMANDS, MOST_SIGNATURE = 64, 4096, 16_000_000


def is_macho(head: bytes) -> bool:
    return head[:4] in THIN or (head[:4] in FAT and len(head) >= 8 and 0 < struct.unpack(">I", head[4:8])[0] <= MOST_SLICES)


def _slices(data: bytes) -> list[tuple[int, int]]:
    """(cpu type, offset) of the slices of a fat file."""
    width = FAT[data[:4]]
    count = min(struct.unpack(">I", data[4:8])[0], MOST_SLICES)
    out = []
    for i in range(count):
        at = 8 + i * width
        if width == 20:
            cpu, _sub, offset = struct.unpack(">III", data[at : at + 12])
        else:
            cpu, _sub, offset = struct.unpack(">IIQ", data[at : at + 16])
        out.append((cpu, offset))
    return out


def _signature(data: bytes) -> tuple[str | None, dict]:
    """Flags and entitlements as far as they can be read; a malformed part leaves out itself only."""
    flags, entitlements = None, {}
    if len(data) < 12:
        return flags, entitlements
    magic, _length, count = struct.unpack(">III", data[:12])
    if magic != SUPERBLOB:
        return flags, entitlements
    for i in range(min(count, 64)):
        try:
            _kind, offset = struct.unpack(">II", data[12 + 8 * i : 20 + 8 * i])
            inner, size = struct.unpack(">II", data[offset : offset + 8])
            if inner == DIRECTORY:
                flags = hex(struct.unpack(">I", data[offset + 12 : offset + 16])[0])
            elif inner == ENTITLEMENTS:
                found = plistlib.loads(data[offset + 8 : offset + size])
                if isinstance(found, dict):
                    entitlements = found
        except Exception:  # property lists fail in many ways
            continue
    return flags, entitlements


def info(data: bytes) -> dict | None:
    """arch, code_sign_flags and entitlements of a Mach-O file, None if it is none."""
    try:
        base, cpu = 0, None
        if data[:4] in FAT:
            slices = _slices(data)
            cpu, base = next((s for s in slices if CPUS.get(s[0], "").startswith("arm64")), slices[0])
        head = data[base : base + 4]
        if head not in THIN:
            return None
        order, size = THIN[head]
        cpu = struct.unpack(order + "I", data[base + 4 : base + 8])[0]
        subtype = struct.unpack(order + "I", data[base + 8 : base + 12])[0] & 0x00FFFFFF
        out = {"arch": SUBTYPES.get((cpu, subtype), CPUS.get(cpu, f"cpu_{cpu:#x}")), "code_sign_flags": None, "entitlements": {}}
        commands = struct.unpack(order + "I", data[base + 16 : base + 20])[0]
        at = base + size
        for _ in range(min(commands, MOST_COMMANDS)):
            if at + 8 > len(data):
                break
            command, length = struct.unpack(order + "II", data[at : at + 8])
            if command == SIGNATURE:
                if at + 16 > len(data):
                    break
                offset, amount = struct.unpack(order + "II", data[at + 8 : at + 16])
                if amount <= MOST_SIGNATURE:
                    out["code_sign_flags"], out["entitlements"] = _signature(data[base + offset : base + offset + amount])  # never raises
                break
            if length < 8:
                break
            at += length
        return out
    except Exception:
        return None
