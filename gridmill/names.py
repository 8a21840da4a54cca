"""Names shared by sources, operators and reports."""

# Labels stored in the tables.
BUILDING = "building_consumption"
NMI = "nmi_consumption"
SUBMETER = "building_submeter_consumption"
SOURCE_SYSTEMS = (BUILDING, NMI, SUBMETER)

LAYERS = ("bronze", "silver", "gold", "reference")
QUALITY_TABLE = "quality.quality_check_results"

METER_KEYS = ("campus_id", "source_system", "meter_id", "building_id")
