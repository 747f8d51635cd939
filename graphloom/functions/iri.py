"""IRIs, references and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH = " / "


def iri_name(iri: Column) -> Column:
    """The fragment, else the last path segment, else the whole."""
    fragment = F.regexp_extract(iri, r"#(.+)$", 1)
    segment = F.regexp_extract(iri, r"/([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.when(fragment != "", fragment).when(segment != "", segment).otherwise(iri)


def ref_iri(ref: Column) -> Column:
    """A reference without its rev and tag."""
    return F.regexp_replace(F.regexp_replace(ref, r"([?&])(?:rev|tag)=[^&]*", "$1"), r"[?&]+$", "")


def ref_rev(ref: Column) -> Column:
    """The revision of a reference, if it names a positive one."""
    rev = F.regexp_extract(ref, r"[?&]rev=(\d+)(?:&|$)", 1).try_cast("int")
    return F.when(rev > 0, rev)


def ref_tag(ref: Column) -> Column:
    """The tag of a reference; a revision wins over it."""
    tag = F.regexp_extract(ref, r"[?&]tag=([^&]+)", 1)
    return F.when(ref_rev(ref).isNull() & (tag != ""), tag)


def ref_kind(ref: Column) -> Column:
    return F.when(ref_rev(ref).isNotNull(), "Revision").when(ref_tag(ref).isNotNull(), "Tag").otherwise("Latest")


def path_split(path: Column) -> Column:
    return F.split(path, PATH)


def path_join(parts: Column) -> Column:
    return F.array_join(parts, PATH)


def project_hash(org: Column, project: Column) -> Column:
    """A name for partitions and aliases of a project."""
    return F.md5(F.concat_ws("/", org, project))


def tag_valid(tag: Column) -> Column:
    """1 to 64 printable ASCII characters; latest is reserved."""
    return tag.rlike(r"^[\x20-\x7E]{1,64}$") & (tag != "latest")
