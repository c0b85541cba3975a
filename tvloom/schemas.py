"""Row types. Strings are empty where nothing is known; `ord` is the place in the input."""

CHANNEL = "source_id string, ord long, name string, stream_url string, group string, tvg_id string, tvg_name string, logo string, attributes map<string,string>, extra_directives array<string>"
SOURCE = (
    "ord long, id string, name string, url string, enabled boolean, priority int, kind string, country string, language string, tags array<string>, "
    "discovery_enabled boolean, discovery_mode string, trust_score int, refresh_hours int, origin string"
)
GUIDE_CHANNEL = "doc_ord long, ord long, channel_id string, display_names array<string>, icon_url string, source_url string"
PROGRAMME = (
    "doc_ord long, ord long, channel_id string, start string, stop string, title string, subtitle string, description string, categories array<string>, "
    "icon_url string, episode_num string, source_url string"
)
RESPONSE = "url string, http_status int, content_type string, final_url string, body binary, error_type string, error string, elapsed_ms int, attempts array<struct<attempt:int,status:string,http_status:int,elapsed_ms:int,error_type:string>>"
