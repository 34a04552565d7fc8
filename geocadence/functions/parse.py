"""Names, codes and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 16 points of the compass, clockwise from north in steps of 22.5 degrees.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
#: Folders that systems leave behind, first bytes of NetCDF files.
JUNK_FOLDERS = ("__MACOSX", ".Trashes", ".Spotlight-V100", ".fseventsd")
MAGIC = ("CDF\x01", "CDF\x02", "CDF\x05", "\x89HDF")
#: Names of time, layer and constituent dimensions.
TIME_DIMS = ("time", "t")
LAYER_DIMS = ("kmaxout_restr", "kmaxout", "kmax", "k", "layer", "nlayers", "zlayer", "laydim")
CONSTITUENT_DIMS = ("lstsci", "ltur", "constituent", "nconst")
#: What is shown for variables without a long name.
KNOWN = {
    "s1": "Water level", "u1": "U velocity", "v1": "V velocity", "r1": "Concentration", "rho": "Density", "taumax": "Bed shear stress (max)",
    "tauksi": "Bed shear stress U", "taueta": "Bed shear stress V", "dps": "Depth", "hsign": "Significant wave height", "hsig": "Significant wave height",
    "hs": "Significant wave height", "dir": "Wave direction", "period": "Wave period", "wlength": "Wavelength", "wlen": "Wavelength", "setup": "Wave set-up", "depth": "Water depth",
}
#: Fields by preference, by name and then by a part of the label.
PREFERRED = ("hsign", "hsig", "hs", "s1", "setup", "taumax", "period", "dir", "wlength", "wlen", "depth", "dps", "u1", "v1", "tauksi", "taueta", "rho", "r1")
PREFERRED_LABELS = ("significant wave height", "water-level", "water level", "set-up", "wave height")


def number(text: Column) -> Column:
    """A finite number, or null for null, ``-``, an empty text and what is no number."""
    value = F.nullif(F.nullif(F.trim(text), F.lit("-")), F.lit("")).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def compass_degrees(code: Column) -> Column:
    """Degrees of a compass point; null for other codes, such as that of a calm."""
    at = F.array_position(F.array(*map(F.lit, COMPASS)), code)
    return F.when(at > 0, (at - 1) * 22.5)


def first_pressure(sea_level: Column, station: Column) -> Column:
    """The pressure at sea level unless it is missing or 0, else that of the station."""
    return F.coalesce(F.nullif(sea_level, F.lit(0.0)), F.nullif(station, F.lit(0.0)))


def station_time(utc: Column) -> Column:
    """Time of ``yyyyMMddHHmmss`` or, with a T between date and time, ``yyyyMMddTHHmmss``; else null."""
    return F.try_to_timestamp(F.substring(F.replace(utc, F.lit("T"), F.lit("")), 1, 14), F.lit("yyyyMMddHHmmss"))


def instant(text: Column) -> Column:
    """Time of an ISO text: ``Z`` or an offset, whose plus may have become a blank, else UTC; null if unreadable."""
    return F.regexp_replace(F.trim(text), r"(\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?) (\d{2}:?\d{2})$", "$1+$2").try_cast("timestamp")


def acquired(name: Column, modified: Column | None = None) -> Column:
    """Acquisition time in a file name, else the time of modification if that is given."""
    found = F.try_to_timestamp(F.regexp_extract(name, r"[0-9]{8}T[0-9]{6}", 0), F.lit("yyyyMMdd'T'HHmmss"))
    return found if modified is None else F.coalesce(found, modified)


def is_junk(path: Column) -> Column:
    """Hidden files and files in hidden or system folders of a relative path."""
    return path.rlike(r"(^|/)\.[^/]*") | path.rlike("(^|/)(" + "|".join(f.replace(".", r"\.") for f in JUNK_FOLDERS) + ")/")


def is_netcdf(head: Column) -> Column:
    """Whether the first four bytes (binary) are those of a NetCDF or HDF5 file."""
    return F.coalesce(F.upper(F.hex(F.substring(head, 1, 4))).isin(*("".join(f"{ord(c):02X}" for c in m) for m in MAGIC)), F.lit(False))


def name_number(value: Column) -> Column:
    """A number as file names hold it: 1.0 is ``1_0``."""
    return F.replace(value.cast("double").cast("string"), F.lit("."), F.lit("_"))


def dim_role(dim: Column) -> Column:
    """time, layer, constituent or other, by the name of a dimension."""
    low = F.lower(dim)
    starts = lambda names: low.rlike("^(" + "|".join(names) + ")")
    return F.when(low.isin(*TIME_DIMS) | low.startswith("time"), "time").when(low.isin(*LAYER_DIMS) | starts([n for n in LAYER_DIMS if len(n) > 1]), "layer").when(starts(CONSTITUENT_DIMS), "constituent").otherwise("other")


def field_label(name: Column, long_name: Column) -> Column:
    """The long name, else the known name of the variable, else its own."""
    known = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    return F.coalesce(F.nullif(long_name, F.lit("")), F.try_element_at(known, F.lower(name)), name)


def field_rank(name: Column, label: Column) -> Column:
    """How far down a field is among those to open a file with: smaller first, 99 for the rest."""
    at = F.array_position(F.array(*map(F.lit, PREFERRED)), F.lower(name))
    low, by_label = F.lower(F.coalesce(label, F.lit(""))), F.lit(99)
    for i, part in reversed(list(enumerate(PREFERRED_LABELS))):
        by_label = F.when(low.contains(part), 20 + i).otherwise(by_label)
    return F.when(at > 0, at - 1).otherwise(by_label).cast("int")


def csv_cell(text: Column) -> Column:
    """A cell of a CSV line: quoted if it holds a quote, comma or line end; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\n]'), quoted).otherwise(text), F.lit(""))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def finite(value: Column) -> Column:
    """Null instead of what JSON can't hold."""
    return F.when(F.abs(value) < float("inf"), value)


def site_key(lon: Column, lat: Column) -> Column:
    return F.format_string("@%.6f,%.6f", lon, lat)


def fingerprint(lon: Column, lat: Column, reach: Column, quals: Column) -> Column:
    """What an extraction depends on; if any of it changes, all files are extracted again."""
    return F.struct(F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), reach.alias("reach"), F.array_sort(quals).alias("quals"))
