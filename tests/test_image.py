import struct

import pytest
import zstandard

from inodelake.sources import image


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """An image with root / a (directory) / f.txt (two blocks), z (compressed) and an unused inode slot."""
    data = bytearray(1040 * 4096)
    packed = zstandard.compress(b"Q" * 9000)
    files = {0: (1, 0, 0, [1027]), 1: (1, 0, 0, [1028]), 2: (0, 5000, 0, [1029, 1031]), 3: (0, 9000, len(packed), [1030]), 5: (0, 7, 0, [1032])}
    struct.pack_into("<IIQQQQQQQ?16sB", data, 0, 0x4F494653, 4096, 1040, 1, 2, 3, 32768, 1027, 0, False, b"s" * 16, 0)
    data[4096] = 0b1111
    data[8192] = 0b11111
    for k, (mode, size, small, blocks) in files.items():
        struct.pack_into("<IQQQQ12Q?24s", data, 3 * 4096 + 256 * k, mode, size, small, 1, 2, *blocks, *[0] * (12 - len(blocks)), False, b"")

    def entries(block, *items):
        at = block * 4096
        for inode, name in items:
            raw = name.encode()
            struct.pack_into(f"<QQH{len(raw)}s", data, at, inode, 0, len(raw), raw)
            at += 18 + len(raw)

    entries(1027, (1, "a"), (3, "zé"))
    entries(1028, (2, "f.txt"))
    data[1029 * 4096 : 1030 * 4096] = b"x" * 4096
    data[1031 * 4096 : 1031 * 4096 + 904] = b"y" * 904
    data[1030 * 4096 : 1030 * 4096 + len(packed)] = packed
    folder = tmp_path_factory.mktemp("images")
    (folder / "one.img").write_bytes(data)
    return image.images(spark, str(folder))


def test_superblock(rows):
    r = rows.first()
    assert (r["block_count"], r["data_block_start"], r["inode_count"], bytes(r["encryption_salt"])) == (1040, 1027, 32768, b"s" * 16)


def test_inodes_and_bitmap(rows):
    got = {r["inode_id"]: (r["mode"], r["size"], r["blocks"][:2]) for r in image.inodes(rows).collect()}
    assert got == {0: ("d", 0, [1027, 0]), 1: ("d", 0, [1028, 0]), 2: ("f", 5000, [1029, 1031]), 3: ("f", 9000, [1030, 0])}
    bits = image.bitmap(rows).where("kind = 'data'")
    assert bits.count() == 13 and bits.where("used").count() == 5


def test_entries_and_contents(rows):
    got = {(r["parent_id"], r["slot"], r["inode_id"], r["name"]) for r in image.dirents(rows).collect()}
    assert got == {(0, 0, 1, "a"), (0, 1, 3, "zé"), (1, 0, 2, "f.txt")}
    assert {r["inode_id"]: bytes(r["content"]) for r in image.contents(rows).collect()} == {2: b"x" * 4096 + b"y" * 904, 3: b"Q" * 9000}


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "no.img").write_bytes(b"\0" * 8192)
    with pytest.raises(Exception, match="not an image"):
        image.images(spark, str(tmp_path)).collect()
