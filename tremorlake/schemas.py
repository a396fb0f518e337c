"""Declared schemas of the tables the package reads and writes."""

STATION = "name STRING, description STRING, x DOUBLE, y DOUBLE, closest_stations ARRAY<STRING>"

# What the station table held about a name from one change up to another.
STATION_STATE = "name STRING, description STRING, x DOUBLE, y DOUBLE, valid_from BIGINT, valid_to BIGINT"

STATION_CHANGE = "seq BIGINT, op STRING, name STRING, description STRING, x DOUBLE, y DOUBLE"

TRACE = (
    "file STRING, trace_no INT, network STRING, station STRING, location STRING, channel STRING, "
    "starttime TIMESTAMP, endtime TIMESTAMP, sampling_rate DOUBLE, delta DOUBLE, npts INT, calib DOUBLE, "
    "data ARRAY<DOUBLE>"
)

BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"

# One decoded waveform record; a trace is a run of adjoining records.
WAVE_RECORD = (
    "file STRING, record_no BIGINT, network STRING, station STRING, location STRING, channel STRING, "
    "start_us BIGINT, sampling_rate DOUBLE, npts INT, data ARRAY<DOUBLE>, error STRING"
)

# Whole records of a waveform file that one task reads.
RECORD_RANGE = "path STRING, first_record BIGINT, offset BIGINT, length BIGINT"

SAMPLE = "station STRING, channel STRING, t TIMESTAMP, data DOUBLE, ingest_seq BIGINT"

SAMPLE_EVENT = "station STRING, channel STRING, time STRING, data DOUBLE, injected_to_preprocessed_at STRING"

PREDICTION = "STRUCT<time: DOUBLE, long: DOUBLE, magnitude: DOUBLE, lat: DOUBLE, depth: DOUBLE>"

STATION_FRAME = (
    "mseed_name STRING, station STRING, E_data DOUBLE, N_data DOUBLE, Z_data DOUBLE, p_Arrival INT, "
    f"sampling_rate INT, time STRING, x INT, data_prediction {PREDICTION}"
)

RAW_NOTIFICATION = "mseed_name STRING, filename STRING"

# The columns a wide frame carries besides the channel_station ones.
RESERVED_FIELDS = ("result", "table", "_field", "_measurement", "_start", "_stop", "_time")
# The channel names of the charts and the stations of the dashboard.
CHANNELS = ("BHE", "BHN", "BHZ")
STATIONS = ("GMJI", "JAGI", "PWJI")
