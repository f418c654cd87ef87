"""Entities of the timeline model, as Spark DDL.  Times are seconds from the start of the video, as doubles."""

VIDEO = "video_id string, title string, duration double, url string, description string"
VIDEO_INFO = "id string, title string, duration double, webpage_url string, description string, chapters array<struct<title:string,start_time:double,end_time:double>>"
CHAPTER = "video_id string, chapter_number int, title string, start_time double, end_time double, is_synthetic boolean, density string"
FRAME = "video_id string, chapter_number int, frame_number int, timestamp double, path string, ocr_text string, is_kept boolean"
CAPTION = "video_id string, caption_idx int, start double, end double, text string"
SEGMENT = "video_id string, seg_idx int, start double, text string"
CUE = "video_id string, timestamp double, tier int, phrase string, context string"
SCENE = "video_id string, scene_id int, start double, end double"
POINT = "video_id string, timestamp double, chapter_number int, density string, scene_id int"
#: Rows of the store, which have ids of their own.
STORED_FRAME = f"id bigint, {FRAME}"
STORED_CHAPTER = f"id bigint, {CHAPTER}"
PROFILE = "name string, scene_sample_interval double, dedup_hamming_threshold int, slide_dedup_hamming_threshold int"
HASHED_FRAME = "video_id string, chapter_number int, timestamp double, phash bigint, is_slide boolean"
