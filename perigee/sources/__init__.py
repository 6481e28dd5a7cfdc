"""Reading landed payloads and writing the layers."""
