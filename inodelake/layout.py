"""Sizes and places of a block-structured image."""

# The image layout.
BLOCK = 4096
SUPERBLOCK, INODE_BITMAP, DATA_BITMAP, INODE_TABLE = 0, 1, 2, 3
MAGIC = 0x4F494653
INODES = 32_768
INODE_TABLE_BLOCKS = 1024
DATA_START = INODE_TABLE + INODE_TABLE_BLOCKS
INODE_SLOT = 256
POINTERS = 12
BITS = 8 * BLOCK
COMPRESS_FROM = 8192
NAME_BYTES = 255
ENTRY_HEAD = 18

#: Slots that fit into the reserved inode table; larger numbers would fall into data blocks.
SAFE_INODES = INODE_TABLE_BLOCKS * BLOCK // INODE_SLOT
