"""A minimal BAM writer for tests."""

import gzip
import struct


def write_bam(path, references, alignments):
    """references: (name, length); alignments: (reference, position, flag, hits), each 4 bases long."""
    out = b"BAM\1" + struct.pack("<ii", 0, len(references))
    for name, length in references:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    for i, (ref, pos, flag, hits) in enumerate(alignments):
        name = f"r{i}".encode()
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, 1, flag, 4, -1, -1, 0)
        body += name + b"\0" + struct.pack("<I", 4 << 4) + bytes(2) + bytes(4) + b"NHC" + bytes([hits])
        out += struct.pack("<i", len(body)) + body
    path.write_bytes(gzip.compress(out))
