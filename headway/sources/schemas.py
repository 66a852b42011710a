"""Column names and types of the tables, as Spark DDL."""

SCHEDULE = {
    "agency": "agency_id string, agency_name string, agency_url string, agency_timezone string, agency_lang string, agency_fare_url string",
    "stops": "stop_id string, stop_code string, stop_name string, stop_desc string, stop_lat decimal(10,8), stop_lon decimal(11,8), zone_id string, stop_url string, location_type int, parent_station string, wheelchair_boarding int",
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_desc string, route_type int, route_url string, route_color string, route_text_color string",
    "trips": "route_id string, service_id string, trip_id string, trip_headsign string, trip_short_name string, direction_id int, block_id string, shape_id string, wheelchair_accessible int, bikes_allowed int",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int, stop_headsign string, pickup_type int, drop_off_type int, shape_dist_traveled decimal(10,4), timepoint int",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
    "shapes": "shape_id string, shape_pt_lat decimal(10,8), shape_pt_lon decimal(11,8), shape_pt_sequence int, shape_dist_traveled decimal(10,4)",
    "transfers": "from_stop_id string, to_stop_id string, transfer_type int, min_transfer_time int, from_trip_id string, to_trip_id string",
    "feed_info": "feed_publisher_name string, feed_publisher_url string, feed_lang string, feed_start_date string, feed_end_date string, feed_version string",
    "directions": "direction string, direction_id int, route_id string, route_short_name string",
}
REQUIRED = ("agency", "stops", "routes", "trips", "stop_times")
DATE_COLUMNS = {
    "calendar": ("start_date", "end_date"),
    "calendar_dates": ("date",),
    "feed_info": ("feed_start_date", "feed_end_date"),
}
CLOCK_COLUMNS = {"stop_times": ("arrival", "departure")}

_TEXT = "struct<translation:array<struct<text:string,language:string>>>"
_TRIP = "struct<trip_id:string,start_time:string,start_date:string,schedule_relationship:int,route_id:string,direction_id:int>"
_VEHICLE = "struct<id:string,label:string,license_plate:string>"
_EVENT = "struct<delay:int,time:bigint,uncertainty:int>"
_STU = f"struct<stop_sequence:int,stop_id:string,arrival:{_EVENT},departure:{_EVENT},schedule_relationship:int>"
_UPDATE = f"struct<trip:{_TRIP},vehicle:{_VEHICLE},stop_time_update:array<{_STU}>,timestamp:bigint>"
_POSITION = "struct<latitude:float,longitude:float,bearing:float,speed:float>"
_SEEN = (
    f"struct<trip:{_TRIP},vehicle:{_VEHICLE},position:{_POSITION},current_stop_sequence:int,stop_id:string,"
    "current_status:int,timestamp:bigint>"
)
_ALERT = (
    "struct<active_period:array<struct<`start`:bigint,`end`:bigint>>,"
    "informed_entity:array<struct<agency_id:string,route_id:string,route_type:int,stop_id:string>>,"
    f"cause:string,effect:string,severity_level:string,url:{_TEXT},header_text:{_TEXT},description_text:{_TEXT},"
    f"cause_detail:{_TEXT},effect_detail:{_TEXT}>"
)
HEADER = "struct<gtfs_realtime_version:string,incrementality:int,timestamp:bigint,feed_version:string>"
ENTITY = f"struct<id:string,is_deleted:boolean,trip_update:{_UPDATE},vehicle:{_SEEN},alert:{_ALERT}>"
FEED = f"header {HEADER}, entity array<{ENTITY}>"
SNAPSHOT = f"feed_type string, file string, file_size bigint, {FEED}, error string"

WEATHER = "date_time_local string, unixtime bigint, pressure_station string, pressure_sea string, wind_dir string, wind_dir_10s string, wind_speed string, wind_gust string, relative_humidity string, dew_point string, temperature string, windchill string, humidex string, visibility string, health_index string, cloud_cover_4 string, cloud_cover_8 string, cloud_cover_10 string, solar_radiation string, max_air_temp_pst1hr string, min_air_temp_pst1hr string, humidex_v string"
WEATHER_NUMBERS = {
    "pressure_station": "decimal(6,2)", "pressure_sea": "decimal(6,2)", "wind_dir_10s": "decimal(5,1)",
    "wind_speed": "int", "relative_humidity": "int", "dew_point": "decimal(4,1)",
    "temperature": "decimal(4,1)", "visibility": "decimal(8,1)", "cloud_cover_8": "decimal(3,1)",
    "max_air_temp_pst1hr": "decimal(4,1)", "min_air_temp_pst1hr": "decimal(4,1)", "humidex_v": "decimal(5,2)",
}
PREDICTIONS = "region_id string, route_id string, direction_id int, stop_id string, stop_sequence int, prediction_created_at timestamp_ntz, prediction_target_time timestamp_ntz, prediction_hour_offset int, predicted_delay_seconds decimal(10,2), predicted_delay_minutes decimal(8,2), model_version string, model_path string, input_data_start timestamp_ntz, input_data_end timestamp_ntz, stop_name string, stop_lat decimal(10,6), stop_lon decimal(11,6), sequence_count int, confidence_score decimal(5,4), prediction_execution_time_ms int, created_at timestamp_ntz"
