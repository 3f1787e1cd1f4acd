"""Schemas of stored and exchanged tables, as DDL."""

QUALITY_CACHE = "photo_hash string, photo_path string, sharpness_score double, exposure_score double, composite_score double, quality_tier string, file_size long, analyzed_at timestamp_ntz, algorithm_version string"
EMOTIONAL_CACHE = "photo_hash string, photo_path string, face_count int, face_coverage double, emotion_score double, intimacy_score double, engagement_score double, composite_score double, tier string, metadata string, file_size long, analyzed_at timestamp_ntz, algorithm_version string"
CANDIDATE = "photo_path string, timestamp timestamp_ntz, month int, quality_score double, emotional_score double, combined_score double, metadata struct<quality_tier: string, emotional_tier: string, has_faces: boolean, face_count: int, has_positive_emotion: boolean>"
STATS = "total_candidates long, avg_quality double, avg_emotional double, avg_combined double, months_represented long, photos_with_faces long, photos_with_smiles long, diversity_score double, min_quality double, max_quality double, min_emotional double, max_emotional double, min_combined double, max_combined double"
SELECTION = f"year int, strategy string, created_at string, stats struct<{STATS}>, photos array<struct<{CANDIDATE}>>"
MEDIA_PAGE = "mediaItems array<struct<id: string, filename: string, baseUrl: string, productUrl: string, mimeType: string, mediaMetadata: struct<creationTime: string, width: string, height: string>>>, nextPageToken string"
FACES = "array<struct<x: int, y: int, w: int, h: int, confidence: double, size_ratio: double, smile: double>>"
IMAGE = "origin string, height int, width int, nChannels int, mode int, data binary"
