"""Explicit schemas of the files that the engine reads."""

from __future__ import annotations

#: Headerless GPS exports: fourteen columns, some of which are dropped.
PINGS_RAW = "id bigint, lat double, lng double, created string, vehicle_id bigint, timestamp string, speed double, bearing double, source int, c10 string, c11 string, deviation_s double, c13 string, c14 string"
STOPS = "stop_id int, stop_name string, lat double, lng double, stop_category string"
TRIPS = "trip_id int, trip_route string, trip_date date"
GTFS_STOP_TIMES = "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int"
ZONES = "zone_id string, lat double, lng double, lat_min double, lat_max double, lng_min double, lng_max double, population long"
TOWERS = "cell_id string, lat double, lng double, azimuth_deg double, beamwidth_deg double, radius_m double"

#: Raw names of mobile-network exports and what they become (fixed values of the formats).
CDR_NAMES = {"IMSI": "imsi", "START_TIME": "ts", "CELL_ID": "cell_id", "LAC": "lac", "TAC": "tac", "CALL_TYPE": "call_type", "DURATION_SEC": "duration_s"}
XDR_NAMES = {"IMSI": "imsi", "TIMESTAMP": "ts", "LOCATION_LAT": "lat", "LOCATION_LON": "lng", "CELL_ID": "cell_id", "TAC": "tac", "LAC": "lac"}
LTE_NAMES = {"IMSI": "imsi", "TIMESTAMP": "ts", "CELL_ID": "cell_id", "TAC": "tac", "RSRP_DBM": "rsrp", "RSRQ_DB": "rsrq", "SINR_DB": "sinr"}
NR_NAMES = {"IMSI": "imsi", "TIMESTAMP": "ts", "NCI": "cell_id", "TAC": "tac", "SS_RSRP_DBM": "rsrp", "SS_RSRQ_DB": "rsrq", "SS_SINR_DB": "sinr"}
REQUIRED = {"cdr": ("imsi", "ts", "cell_id"), "xdr": ("imsi", "ts"), "lte": ("cell_id",), "nr": ("cell_id",)}
TELECOM = {"cdr": CDR_NAMES, "xdr": XDR_NAMES, "lte": LTE_NAMES, "nr": NR_NAMES}
