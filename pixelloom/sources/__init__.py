"""Sources and sinks: image files to packed rows and back."""
