"""Climate classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 30 classes of the Koeppen-Geiger climate raster.
KOPPEN = {
    1: ("Af", "Tropical, rainforest"),
    2: ("Am", "Tropical, monsoon"),
    3: ("Aw", "Tropical, savannah"),
    4: ("BWh", "Arid, desert, hot"),
    5: ("BWk", "Arid, desert, cold"),
    6: ("BSh", "Arid, steppe, hot"),
    7: ("BSk", "Arid, steppe, cold"),
    8: ("Csa", "Temperate, dry summer, hot summer"),
    9: ("Csb", "Temperate, dry summer, warm summer"),
    10: ("Csc", "Temperate, dry summer, cold summer"),
    11: ("Cwa", "Temperate, dry winter, hot summer"),
    12: ("Cwb", "Temperate, dry winter, warm summer"),
    13: ("Cwc", "Temperate, dry winter, cold summer"),
    14: ("Cfa", "Temperate, no dry season, hot summer"),
    15: ("Cfb", "Temperate, no dry season, warm summer"),
    16: ("Cfc", "Temperate, no dry season, cold summer"),
    17: ("Dsa", "Cold, dry summer, hot summer"),
    18: ("Dsb", "Cold, dry summer, warm summer"),
    19: ("Dsc", "Cold, dry summer, cold summer"),
    20: ("Dsd", "Cold, dry summer, very cold winter"),
    21: ("Dwa", "Cold, dry winter, hot summer"),
    22: ("Dwb", "Cold, dry winter, warm summer"),
    23: ("Dwc", "Cold, dry winter, cold summer"),
    24: ("Dwd", "Cold, dry winter, very cold winter"),
    25: ("Dfa", "Cold, no dry season, hot summer"),
    26: ("Dfb", "Cold, no dry season, warm summer"),
    27: ("Dfc", "Cold, no dry season, cold summer"),
    28: ("Dfd", "Cold, no dry season, very cold winter"),
    29: ("ET", "Polar, tundra"),
    30: ("EF", "Polar, frost"),
}

# Names of the codes of European ecosystem rasters (numbers) and habitat classes (letters).
ECOSYSTEMS = {
    "1": "Urban / Artificial",
    "2": "Cropland / Agricultural",
    "3": "Grassland",
    "4": "Woodland and forest",
    "5": "Heathland and shrub",
    "6": "Sparsely vegetated land",
    "7": "Wetland / Mire / Bog",
    "8": "Rivers and lakes (Inland water)",
    "9": "Marine / Sea",
    "10": "Coastal / Dunes",
    "A": "Marine habitats",
    "B": "Coastal habitats",
    "C": "Inland surface waters",
    "D": "Mires, bogs and fens",
    "E": "Grasslands",
    "F": "Heathland, scrub and tundra",
    "G": "Woodland, forest and other wooded land",
    "H": "Inland habitats with very sparse or no vegetation",
    "I": "Cultivated agricultural, horticultural and domestic habitats",
    "J": "Constructed, industrial and other artificial habitats",
}

# Names of the environmental zones of Europe by raster value.
ENVIRONMENTAL_ZONES = {
    "1": "Alpine North (ALN)",
    "2": "Boreal (BOR)",
    "3": "Nemoral (NEM)",
    "4": "Atlantic North (ATN)",
    "5": "Atlantic Central (ATC)",
    "6": "Lusitanian (LUS)",
    "7": "Alpine South (ALS)",
    "8": "Continental (CON)",
    "9": "Pannonian (PAN)",
    "10": "Mediterranean North (MDN)",
    "11": "Mediterranean Mountains (MDM)",
    "12": "Mediterranean South (MDS)",
    "13": "Aegean (AEG)",
    "14": "Blacksea climate region (BSC)",
    "15": "Central Anatolian (CAN)",
    "16": "Eastern Anatolian (EAN)",
    "17": "Southwest Anatolian transition region (SAN)",
    "18": "Macaronesian (MAC)",
    "19": "Arctic (ARC)",
}


def named(value: Column, names: dict[str, str], unknown: str = "Unknown") -> Column:
    """The name of a raster value: by its text, else by its whole number."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    text = F.trim(value.cast("string"))
    whole = value.try_cast("double").cast("long").cast("string")
    return F.coalesce(F.try_element_at(table, text), F.try_element_at(table, whole), F.lit(unknown))
