"""Settings of a classifier's training; training itself is not part of the engine."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

SPLITS = ("train", "valid", "test")


@dataclass(frozen=True)
class Training:
    """Defaults suit a data set of about a thousand images on one GPU."""

    epochs: int = 100
    batch: int = 16
    image_size: int = 640
    patience: int = 20
    seed: int = 0
    splits: tuple[str, ...] = SPLITS
    augment: dict[str, float] = field(default_factory=lambda: {"fliplr": 0.5, "flipud": 0.5})

    def arguments(self) -> dict:
        """As a trainer takes them; augmentations beside the rest."""
        own = asdict(self)
        more = own.pop("augment")
        own.pop("splits")
        return own | more
