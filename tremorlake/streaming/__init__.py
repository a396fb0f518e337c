"""The frame, picker and alert operators on streams."""
