"""Names of the codes in TIFF tags and GeoKeys, after the TIFF 6.0 and GeoTIFF 1.0 specifications.

Short lists stand here as they are; families of codes follow from rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values of the TIFF specification
PHOTOMETRIC = ("WhiteIsZero", "BlackIsZero", "RGB", "Paletted", "TransMask", "pCMYK", "pYCbCr", "pCIELab")  # from 0
COMPRESSION = {1: "None", 2: "CCITT", 3: "G3", 4: "G4", 5: "LZW", 6: "JPEGOld", 7: "JPEG", 8: "Deflate", 32773: "PackBits", 32946: "DeflateOld"}
PREDICTOR = ("None", "Horizontal")  # this and the following from 1
PLANES = ("Contiguous", "Separate")
RESOLUTION_UNITS = ("None", "Dots per inch", "Dots per centimeter")
SAMPLE_FORMAT = ("Unsigned integer data", "Signed integer data", "Floating point data", "Undefined data format")

# fixed values of the GeoTIFF specification
MODEL_TYPES = ("ModelTypeProjected", "ModelTypeGeographic", "ModelTypeGeocentric")
RASTER_TYPES = ("RasterPixelIsArea", "RasterPixelIsPoint")
LINEAR_UNITS = (  # from 9001
    "Meter", "Foot", "Foot_US_Survey", "Foot_Modified_American", "Foot_Clarke", "Foot_Indian", "Link", "Link_Benoit", "Link_Sears", "Chain_Benoit",
    "Chain_Sears", "Yard_Sears", "Yard_Indian", "Fathom", "Mile_International_Nautical",
)
ANGULAR_UNITS = ("Radian", "Degree", "Arc_Minute", "Arc_Second", "Grad", "Gon", "DMS", "DMS_Hemisphere")  # from 9101
PRIME_MERIDIANS = ("Greenwich", "Lisbon", "Paris", "Bogota", "Madrid", "Rome", "Bern", "Jakarta", "Ferro", "Brussels", "Stockholm")  # from 8901
ELLIPSOIDS = (  # from 7001
    "Airy_1830", "Airy_Modified_1849", "Australian_National_Spheroid", "Bessel_1841", "Bessel_Modified", "Bessel_Namibia", "Clarke_1858", "Clarke_1866",
    "Clarke_1866_Michigan", "Clarke_1880_Benoit", "Clarke_1880_IGN", "Clarke_1880_RGS", "Clarke_1880_Arc", "Clarke_1880_SGA_1922",
    "Everest_1830_1937_Adjustment", "Everest_1830_1967_Definition", "Everest_1830_1975_Definition", "Everest_1830_Modified", "GRS_1980", "Helmert_1906",
    "Indonesian_National_Spheroid", "International_1924", "International_1967", "Krassowsky_1940", "NWL_9D", "NWL_10D", "Plessis_1817", "Struve_1860",
    "War_Office", "WGS_84", "GEM_10C", "OSU86F", "OSU91A", "Clarke_1880", "Sphere",
)
GEOGRAPHIC = (  # from 4201
    "Adindan", "AGD66", "AGD84", "Ain_el_Abd", "Afgooye", "Agadez", "Lisbon", "Aratu", "Arc_1950", "Arc_1960", "Batavia", "Barbados", "Beduaram",
    "Beijing_1954", "Belge_1950", "Bermuda_1957", "Bern_1898", "Bogota", "Bukit_Rimpah", "Camacupa", "Campo_Inchauspe", "Cape", "Carthage", "Chua",
    "Corrego_Alegre", "Cote_d_Ivoire", "Deir_ez_Zor", "Douala", "Egypt_1907", "ED50", "ED87", "Fahud", "Gandajika_1970", "Garoua", "Guyane_Francaise",
    "Hu_Tzu_Shan", "HD72", "ID74", "Indian_1954", "Indian_1975", "Jamaica_1875", "JAD69", "Kalianpur", "Kandawala", "Kertau", "KOC", "La_Canoa", "PSAD56",
    "Lake", "Leigon", "Liberia_1964", "Lome", "Luzon_1911", "Hito_XVIII_1963", "Herat_North", "Mahe_1971", "Makassar", "EUREF89", "Malongo_1987", "Manoca",
    "Merchich", "Massawa", "Minna", "Mhast", "Monte_Mario", "M_poraloko", "NAD27", "NAD_Michigan", "NAD83", "Nahrwan_1967", "Naparima_1972", "GD49",
    "NGO_1948", "Datum_73", "NTF", "NSWC_9Z_2", "OSGB_1936", "OSGB70", "OS_SN80", "Padang", "Palestine_1923", "Pointe_Noire", "GDA94", "Pulkovo_1942",
    "Qatar", "Qatar_1948", "Qornoq", "Loma_Quintana", "Amersfoort", "RT38", "SAD69", "Sapper_Hill_1943", "Schwarzeck", "Segora", "Serindung", "Sudan",
    "Tananarive", "Timbalai_1948", "TM65", "TM75", "Tokyo", "Trinidad_1903", "TC_1948", "Voirol_1875", "Voirol_Unifie", "Bern_1938", "Nord_Sahara_1959",
    "Stockholm_1938", "Yacare", "Yoff", "Zanderij", "MGI", "Belge_1972", "DHDN", "Conakry_1905",
)
WORLD = {4322: "WGS_72", 4324: "WGS_72BE", 4326: "WGS_84"}
TRANSFORMATIONS = (  # from 1
    "TransverseMercator", "TransvMercator_Modified_Alaska", "ObliqueMercator", "ObliqueMercator_Laborde", "ObliqueMercator_Rosenmund",
    "ObliqueMercator_Spherical", "Mercator", "LambertConfConic_2SP", "LambertConfConic_Helmert", "LambertAzimEqualArea", "AlbersEqualArea",
    "AzimuthalEquidistant", "EquidistantConic", "Stereographic", "PolarStereographic", "ObliqueStereographic", "Equirectangular", "CassiniSoldner",
    "Gnomonic", "MillerCylindrical", "Orthographic", "Polyconic", "Robinson", "Sinusoidal", "VanDerGrinten", "NewZealandMapGrid",
    "TransvMercator_SouthOriented",
)
# families of projected systems: first code, first zone, last zone, name around the zone
ZONES = (
    (20248, 48, 58, "PCS_AGD66_AMG_zone_{}"), (20348, 48, 58, "PCS_AGD84_AMG_zone_{}"), (23028, 28, 38, "PCS_ED50_UTM_zone_{}N"), (24818, 18, 21, "PCS_PSAD56_UTM_zone_{}N"),
    (24877, 17, 20, "PCS_PSAD56_UTM_zone_{}S"), (26703, 3, 22, "PCS_NAD27_UTM_zone_{}N"), (26903, 3, 23, "PCS_NAD83_UTM_zone_{}N"), (28348, 48, 58, "PCS_GDA94_MGA_zone_{}"),
    (28404, 4, 32, "PCS_Pulkovo_Gauss_zone_{}"), (29118, 18, 22, "PCS_SAD69_UTM_zone_{}N"), (29177, 17, 25, "PCS_SAD69_UTM_zone_{}S"), (32201, 1, 60, "PCS_WGS72_UTM_zone_{}N"),
    (32301, 1, 60, "PCS_WGS72_UTM_zone_{}S"), (32401, 1, 60, "PCS_WGS72BE_UTM_zone_{}N"), (32501, 1, 60, "PCS_WGS72BE_UTM_zone_{}S"), (32601, 1, 60, "PCS_WGS84_UTM_zone_{}N"),
    (32701, 1, 60, "PCS_WGS84_UTM_zone_{}S"),
)


def _from(first: int, names, before: str = "") -> dict[int, str]:
    return {first + k: before + n for k, n in enumerate(names)}


def _tables() -> dict[int, dict[int, str]]:
    bare = [e.replace("_", "") for e in ELLIPSOIDS]  # systems and datums that are no more than an ellipsoid have its code less 3000 and 1000
    systems = _from(4201, GEOGRAPHIC) | WORLD
    utm = {16000 + 100 * k + zone: f"Proj_UTM_zone_{zone}{side}" for k, side in enumerate("NS") for zone in range(1, 61)}
    return {
        259: COMPRESSION, 262: _from(0, PHOTOMETRIC), 284: _from(1, PLANES), 296: _from(1, RESOLUTION_UNITS), 317: _from(1, PREDICTOR), 339: _from(1, SAMPLE_FORMAT),
        1024: _from(1, MODEL_TYPES), 1025: _from(1, RASTER_TYPES), 2048: _from(4001, bare, "GCSE_") | {k: f"GCS_{n}" for k, n in systems.items()},
        2050: _from(6001, bare, "DatumE_") | {k + 2000: f"Datum_{n}" for k, n in systems.items()},  # a datum's code is its system's plus 2000
        2051: _from(8901, PRIME_MERIDIANS, "PM_"), 2052: _from(9001, LINEAR_UNITS, "Linear_"), 2054: _from(9101, ANGULAR_UNITS, "Angular_"),
        2056: _from(7001, ELLIPSOIDS, "Ellipse_"), 3072: {first + z - a: name.format(z) for first, a, end, name in ZONES for z in range(a, end + 1)},
        3074: utm, 3075: _from(1, TRANSFORMATIONS, "CT_"), 3076: _from(9001, LINEAR_UNITS, "Linear_"), 4099: _from(9001, LINEAR_UNITS, "Linear_"),
    }


TABLES = _tables()


def keyword(tag: int, value) -> str | None:
    """The name of a tag's or key's value, if it is a code with one."""
    return TABLES.get(tag, {}).get(value) if isinstance(value, int) else None


def code_table(spark: SparkSession) -> DataFrame:
    """``(tag, code, name)``: a small dimension table."""
    return spark.createDataFrame([(t, c, n) for t, m in TABLES.items() for c, n in m.items()], "tag int, code int, name string")
