"""Fixed vocabularies of the domain."""

# Fields of each document type.
FIELDS = {
    "aadhaar": ["name", "date_of_birth", "gender", "aadhaar_number"],
    "pan": ["name", "fathers_name", "date_of_birth", "pan_number"],
    "driving_license": ["license_number", "name", "fathers_name", "date_of_birth", "issue_date", "expiry_date", "address", "vehicle_classes"],
    "unknown": [],
}
# Detector classes by id.
DETECTOR = ["name", "date_of_birth", "gender", "aadhaar_number", "pan_number", "fathers_name"]
# Source class to detector class; None is left out on purpose, an absent class is an error.
CLASS_MAP = {"aadhaar": {0: 3, 1: 1, 2: 2, 3: 0, 4: None}, "pan": {0: 1, 1: 5, 2: 0, 3: 4}}
# Characters of the recogniser, ids from 1; 0 is the blank.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789/ "
IGNORED_FILES = [".gitkeep", ".DS_Store", "Thumbs.db", "desktop.ini"]
SAMPLE_SOURCES = ["synthetic", "real"]
SPLITS = ["train", "valid", "test"]
