"""Fixed values of the format and of the model rules."""

MIN_WINDOW = 16
#: (block shorter than, longest window); the last holds for all others.
WINDOW_CAPS = ((5_000, 512), (100_000, 1024), (None, 4096))
LOCAL_VARIANCE, GLOBAL_VARIANCE, FLAT_VARIANCE, STAGNATION = 10.0, 0.10, 1e-20, 1.5
XOR_PREFERENCE, CONSTANT_PREFERENCE = 1.02, 1.01
QUADRATIC_WINDOW, SINUSOID_WINDOW, SINUSOID_STEPS, SINUSOID_DAMPING = 4, 32, 50, 1e-4
PRECISION, MIN_PRECISION, MAX_PRECISION, BOUND = 16, 8, 20, 8e-6
MAD_FACTOR, MAD_LENGTH, BLOCK_DOD_LENGTH, CHUNK = 4.5, 8, 64, 100_000
LINEAR, QUADRATIC, XOR, CONSTANT, SINUSOID, PRED_XOR = range(6)
PARAMS = {LINEAR: 2, QUADRATIC: 3, XOR: 1, CONSTANT: 1, SINUSOID: 4, PRED_XOR: 2}
#: Containers are this engine's own: their marks and version.
MAGIC, FOOTER_MAGIC, VERSION = b"TMK\x02", b"\xed\xdc\xba\x01", (1, 0)
#: Decimal exponents and divisors of the decimal codec, values in one of its chunks, and where its integers end.
ALP_EXPONENTS, ALP_FACTORS, ALP_CHUNK, ALP_LIMIT = range(12), (1, 2, 4, 5, 8, 10, 16, 20, 25, 50, 100), 1024, 2.0**62
