"""Raw table schemas, contact and override readers, and table sinks."""
