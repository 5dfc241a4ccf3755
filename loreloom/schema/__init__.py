"""User-defined schemas of story subjects: grammar, catalogue, validation, examples."""
