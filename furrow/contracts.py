"""Event contracts: names, domains, ranges and schemas.

Everything a deployment may want to look up or change sits here as plain data.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Names, domains, phrases and thresholds that results depend on.
# --------------------------------------------------------------------------

SATELLITE = "satellite_observation"
WEATHER = "weather_observation"
SOIL = "soil_sensor_reading"
REPORT = "farmer_report"
MARKET = "market_price_update"

TOPICS = {
    SATELLITE: "agri.satellite.raw",
    WEATHER: "agri.weather.raw",
    SOIL: "agri.iot.raw",
    REPORT: "agri.reports.raw",
    MARKET: "agri.market.raw",
}
TOPIC_OTHER = "agri.misc.raw"

STATES = ["WB", "UP", "MH", "KA", "PB", "RJ", "MP", "GJ", "TN", "AP"]
CROPS = ["rice", "wheat", "sugarcane", "cotton", "maize", "mustard", "groundnut"]
PESTS = ["locust", "bollworm", "stem_borer", "aphid", "blast"]
SOIL_TYPES = ["clay", "loam", "sandy", "silt"]
LANGUAGES = ["hi", "bn", "mr", "ta", "te", "gu", "pa", "en"]
REPORT_TYPES = ["pest_sighting", "disease_symptom", "irrigation_issue", "harvest_ready"]
SEVERITIES = ["low", "medium", "high", "critical"]
CHANNELS = ["whatsapp", "sms", "voice_call"]
MARKETS = [
    "Delhi", "Mumbai", "Kolkata", "Chennai", "Bangalore", "Hyderabad", "Ahmedabad", "Pune",
]

PLOT_ID_PATTERN = "^[A-Z]{2}_[0-9]{3}_[0-9]{1,3}$"

# alert type -> (severity, threshold); the comparison is strict
NDVI_ALERT = ("low_vegetation_health", "high", 0.3)
MOISTURE_ALERT = ("low_soil_moisture", "critical", 25.0)
HEAT_ALERT = ("heat_stress", "medium", 38.0)
NDVI_MESSAGE = "Low NDVI detected: %.2f"
MOISTURE_MESSAGE = "Irrigation needed: moisture at %.1f%%"
HEAT_MESSAGE = "Heat stress warning: %.1f°C"

SEVERITY_EMOJI = {"low": "ℹ️", "medium": "⚠️", "high": "🚨", "critical": "🆘"}
EMOJI_OTHER = "⚠️"

# keyword -> phrase key, in order of precedence
PHRASE_KEYWORDS = [
    ("irrigation", "irrigation_needed"),
    ("pest", "pest_detected"),
    ("weather", "weather_alert"),
]
PHRASES = {
    "hi": {
        "irrigation_needed": "सिंचाई की आवश्यकता है",
        "pest_detected": "कीट का पता चला",
        "weather_alert": "मौसम चेतावनी",
    },
    "bn": {
        "irrigation_needed": "সেচের প্রয়োজন",
        "pest_detected": "পোকা শনাক্ত করা হয়েছে",
        "weather_alert": "আবহাওয়া সতর্কতা",
    },
}

DISPLAY_TEXT = (
    "{emoji} *कृषि सतर्कता | Agricultural Alert*\n"
    "\n"
    "📍 Plot: {plot}\n"
    "🔔 Type: {type}\n"
    "⚡ Severity: {severity}\n"
    "\n"
    "📝 {message}\n"
    "\n"
    "💡 Recommendation: Take immediate action.\n"
)
LOCAL_TEXT = "\n\n{text}"
SMS_TEXT = "Alert: {type}. {message}"
SUBJECT_TEXT = "Agri Alert: {type}"
DELIVERY_PREFIXES = {"whatsapp": "wa_", "sms": "sms_", "voice_call": "voice_", "sns": "sns_"}
REPORT_SENTENCE = r"^Observed (\w+) on (\w+)$"

DEFAULT_LANGUAGE = "en"
DEFAULT_CHANNEL = "whatsapp"
DEFAULT_SEVERITY = "medium"
UNKNOWN_PLOT = "unknown"
SMS_BODY_CHARS = 100

RECOMMENDATIONS = {
    "low_soil_moisture": "Irrigate within 2 days",
    "pest_sighting": "Monitor for pest activity",
    "low_vegetation_health": "Inspect crop health",
    "heat_stress": "Provide shade or mulch",
}

HEALTH_SCORE_RANGE = (0.0, 1.0)

# event type -> reading -> (low, high), both ends allowed
RANGES = {
    SATELLITE: {"ndvi": (0.2, 0.8), "evi": (0.15, 0.6), "cloud_cover": (0.0, 0.4)},
    WEATHER: {
        "temperature_c": (20.0, 40.0),
        "humidity_pct": (40.0, 90.0),
        "precipitation_mm": (0.0, 50.0),
        "wind_speed_kmh": (5.0, 30.0),
        "temp_max": (25.0, 42.0),
        "rain_probability": (0.0, 1.0),
    },
    SOIL: {
        "moisture_pct": (20.0, 60.0),
        "ph": (5.5, 7.5),
        "nitrogen_ppm": (200.0, 400.0),
        "phosphorus_ppm": (15.0, 40.0),
        "potassium_ppm": (150.0, 300.0),
        "temperature_c": (22.0, 32.0),
        "battery_level": (60.0, 100.0),
    },
    REPORT: {"lat": (20.0, 30.0), "lon": (80.0, 90.0)},
    MARKET: {
        "price_per_quintal_inr": (1500.0, 4500.0),
        "arrival_quantity_mt": (50.0, 500.0),
        "price_change_pct": (-5.0, 5.0),
    },
}

# event type -> column -> allowed values
MEMBERSHIP = {
    SOIL: {"soil_type": SOIL_TYPES},
    REPORT: {
        "report_type": REPORT_TYPES,
        "language": LANGUAGES,
        "severity": SEVERITIES,
        "channel": CHANNELS,
    },
    MARKET: {"crop": CROPS, "market_location": MARKETS},
}

# decimals each reading is rounded to at its source
READING_DECIMALS = {
    "ndvi": 3, "evi": 3, "cloud_cover": 2,
    "temperature_c": 1, "humidity_pct": 1, "precipitation_mm": 2, "wind_speed_kmh": 1,
    "temp_max": 1, "rain_probability": 2,
    "moisture_pct": 1, "ph": 2, "nitrogen_ppm": 1, "phosphorus_ppm": 1, "potassium_ppm": 1,
    "battery_level": 1, "lat": 4, "lon": 4,
    "price_per_quintal_inr": 2, "arrival_quantity_mt": 1, "price_change_pct": 2,
}

# keys of the nested data object per event type
DATA_KEYS = {
    SATELLITE: ["ndvi", "evi", "cloud_cover", "resolution_m", "band_combination"],
    WEATHER: [
        "temperature_c", "humidity_pct", "precipitation_mm", "wind_speed_kmh", "forecast_3d",
    ],
    SOIL: [
        "moisture_pct", "ph", "nitrogen_ppm", "phosphorus_ppm", "potassium_ppm", "temperature_c",
    ],
    REPORT: ["report_type", "description", "language", "severity", "image_url"],
    MARKET: [
        "price_per_quintal_inr", "arrival_quantity_mt", "price_change_pct", "market_location",
    ],
}

# readings expected per plot and day; a satellite pass is due once in three days
CADENCE_PER_DAY = {WEATHER: 4, SOIL: 7}
SATELLITE_EVERY_DAYS = 3
PRICES_PER_CROP_DAY = 1

# alarm limits of the pipeline-health reports
LAG_LIMIT = 1000
LAG_GROWTH_LIMIT = 50
DLQ_LIMIT = 50
LATENCY_P95_LIMIT_MS = 2000.0
API_P95_LIMIT_MS = 500.0

# --------------------------------------------------------------------------
# Our own definitions, fixed nowhere else.
# --------------------------------------------------------------------------

WINDOW = "1 hour"
WATERMARK_DELAY = "1 hour"
CHECKPOINT_EVERY = "60 seconds"
JOIN_LOOKBACK_HOURS = 6

# reading -> (zero point, span) of the linear health component, clamped to [0, 1]
HEALTH_NDVI = (0.2, 0.6)
HEALTH_MOISTURE = (20.0, 40.0)
HEALTH_HEAT = (40.0, 20.0)

# soil rating: a reading is good when it lies within these bounds
SOIL_GOOD = {
    "moisture_pct": (25.0, None),
    "ph": (6.0, 7.5),
    "nitrogen_ppm": (240.0, None),
    "phosphorus_ppm": (20.0, None),
    "potassium_ppm": (180.0, None),
}

# --------------------------------------------------------------------------
# Schemas, as DDL strings.
# --------------------------------------------------------------------------

DATA_DDL = (
    "ndvi double, evi double, cloud_cover double, resolution_m int, band_combination string, "
    "temperature_c double, humidity_pct double, precipitation_mm double, wind_speed_kmh double, "
    "forecast_3d struct<temp_max: double, rain_probability: double>, "
    "moisture_pct double, ph double, nitrogen_ppm double, phosphorus_ppm double, "
    "potassium_ppm double, "
    "report_type string, description string, language string, severity string, image_url string, "
    "price_per_quintal_inr double, arrival_quantity_mt double, price_change_pct double, "
    "market_location string"
)
METADATA_DDL = (
    "satellite string, processing_level string, source string, station_id string, "
    "sensor_id string, battery_level double, soil_type string, farmer_id string, channel string, "
    "location struct<lat: double, lon: double>, market_yard_id string"
)
ENVELOPE_FIELDS = "event_uuid string, event_type string, timestamp string, plot_id string, crop string"

# one parse gives every field of every event type; absent keys are null
EVENT_DDL = f"{ENVELOPE_FIELDS}, data struct<{DATA_DDL}>, metadata struct<{METADATA_DDL}>"
# the same envelope with the nested objects kept as text, for contract checks
RAW_EVENT_DDL = f"{ENVELOPE_FIELDS}, data string, metadata string"

ALERT_DDL = (
    "alert_id string, plot_id string, alert_type string, severity string, message string, "
    "timestamp timestamp, acknowledged boolean"
)
CONTACT_DDL = (
    "farmer_id string, phone string, preferred_language string, preferred_channel string"
)
PLOT_DDL = (
    "plot_id string, state string, district string, crop_type string, area_hectares double, "
    "farmer_name string, farmer_id string"
)
ATTEMPT_DDL = (
    "alert_id string, success boolean, message_id string, channel string, error string, "
    "attempt int, ts timestamp, payload string"
)
