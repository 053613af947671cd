"""Operations of a training-data pipeline: decontamination, licences, tokenising, archives, classifiers, media, deduplication, URL rules."""
