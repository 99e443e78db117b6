"""Explicit schemas, as DDL, and versions of the stored tables. Nothing is inferred."""

from __future__ import annotations


REPO_VERSION = 1
NODE_VERSION = 1
SNAPSHOT_VERSION = 1
PACK_VERSION = 1

#: Values of the pack format.
PACK_MAGIC = b"CRNP"
PACK_HEADER = 5
ENTRY_HEADER = 36

INDEX = "chunk_id string, pack_id string, offset bigint, length bigint"
#: A path of a scan, or a chunk of a file (type piece, with path, seq and data alone). reason is set, and all else but path and depth null, where something could not be read.
SCAN = "path string, depth int, type string, mode int, uid bigint, gid bigint, mtime_ns bigint, size bigint, link_target string, reason string, file_hash string, seq int, data binary"
ENTRY = "struct<chunks:array<string>,file_hash:string,meta:struct<gid:bigint,link_target:string,mode:int,mtime_ns:bigint,size:bigint,type:string,uid:bigint>,name:string,tree:string>"
NODE = f"struct<entries:array<{ENTRY}>,v:int>"
STATS = "struct<files:bigint,dirs:bigint,symlinks:bigint,bytes_read:bigint,chunks_new:bigint,skipped:bigint>"
CONFIG = "format_version int, created double, chunk_min int, chunk_avg int, chunk_max int, repack_threshold double, pack_size bigint, kdf_n int, kdf_r int, kdf_p int, salt string, wrapped_key string"
