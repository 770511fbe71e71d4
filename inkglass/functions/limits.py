"""Resource limits of an inspection."""

MIB = 1 << 20
FILE_BYTES = 64 * MIB
FORMAT_BYTES = {"jpeg": 48 * MIB, "png": 48 * MIB, "pdf": 64 * MIB, "docx": 32 * MIB}
DECODE_PIXELS, COMPARE_PIXELS, DECODE_EDGE = 36_000_000, 16_000_000, 16_384
JPEG_SEGMENTS, PNG_CHUNKS = 4096, 20_000
IFD_ENTRIES, IFDS, TAG_BYTES = 512, 12, MIB
DISPLAY_CHARS = 400
FINDINGS, ESSENTIAL_MORE = 600, 100
INFLATE_CHUNK, INFLATE_FILE = 256 * 1024, 2 * MIB
IPTC_DATASETS, XMP_BYTES, ICC_BYTES = 256, MIB, 4 * MIB
PDF_PAGES = 200
ZIP_ENTRIES, ZIP_PART, ZIP_INFLATE, ZIP_DECLARED, ZIP_RATIO = 2000, 512 * 1024, 6 * MIB, 512 * MIB, 1000
SECONDS = 30
TAG_CHARS = 4000
ELEMENTS = 20
SNIFF_BYTES = 1032
