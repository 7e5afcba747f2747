"""An HTTP and command-line face of the engine."""
