"""Schemas of the canonical tables. Time is whole samples, whole frames or decimal seconds."""

SAMPLE_RATE = 16_000
FRAME_WINDOW, FRAME_SHIFT = 1024, 256

EXAMPLE = "dataset STRING, example_id STRING, embedding_id STRING, start BIGINT, `end` BIGINT, n_samples BIGINT, num_speakers INT, observation ARRAY<STRING>, speaker_source ARRAY<STRING>, rir ARRAY<STRING>, noise_image STRING"
UTTERANCE = "dataset STRING, example_id STRING, ord INT, speaker_id STRING, source_id STRING, offset BIGINT, num_samples BIGINT, transcription STRING, gender STRING"
SEGLST = "dataset STRING, session_id STRING, speaker STRING, start_frame BIGINT, stop_frame BIGINT, start_sample BIGINT, end_sample BIGINT, start_time DECIMAL(18,7), end_time DECIMAL(18,7), words STRING, words_orig STRING, audio_path STRING"
INTERVAL = "dataset STRING, session_id STRING, speaker STRING, s BIGINT, e BIGINT"
SPEAKER_EMBEDDING = "dataset STRING, example_id STRING, speaker_id STRING, ord INT, path STRING, duration DOUBLE, embedding ARRAY<FLOAT>"
SCORE = "session_id STRING, errors BIGINT, length BIGINT"
