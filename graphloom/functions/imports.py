"""What code imports: packages named by import statements, dynamic imports and include lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in import position that name no package, the packages that single headers stand for, headers of
# systems and frameworks that come by themselves, and headers of a project's own.
NO_PACKAGE = ("file", "module", "source", "path", "lines", "code")
HEADER_PACKAGES = {"lvgl": "lvgl", "CST816S": "CST816S", "ArduinoJson": "ArduinoJson", "WiFi": "esp32", "BluetoothSerial": "esp32", "FS": "esp32", "SD": "esp32", "SPI": "esp32", "Wire": "esp32", "HTTPClient": "esp32"}
SYSTEM_HEADERS = ("esp_", "freertos", "driver", "hal", "soc", "sdkconfig", "std", "string", "cmath", "cstd", "cint", "cstr", "sys/", "linux/", "asm/")
FRAMEWORK_HEADERS = (
    "Arduino", "WiFi", "BluetoothSerial", "FS", "SD", "SPI", "Wire", "HTTPClient", "Update", "time", "Preferences", "SD_MMC", "esp_now", "BLEAdvertisedDevice", "BLEClient", "BLEDevice", "BLEServer", "BLEUtils", "BLE2902",
    "BLEScan", "BLECharacteristic", "BLEDescriptor", "BLEService", "BLESecurity", "BLEAddress", "BLEBeacon", "BLEEddystoneURL", "Print", "Stream", "WString", "String",
    "esp32", "esp32s3", "esp32c3", "api", "font", "canvas", "gfxfont", "avr", "pgmspace", "sys", "float", "hardware", "platform", "REG", "databus", "display", "VNC", "VNC_config", "driver", "service", "lv_demo_benchmark", "math", "JPEGDEC", "ESP32_JPEG_Library",
)
FRAMEWORK_STARTS = ("Arduino_", "Adafruit_", "Sensor", "XPowers", "Powers")
LOCAL_HEADERS = (
    "audio", "ble_hid", "ble_srv", "ota_update", "wifi_ntp", "tf_card", "voice_chat", "activity", "weather", "player", "stopwatch", "backlight", "watch_faces", "ui_pages", "settings_page", "step_counter", "sleep_tracker", "motion_intensity", "notif_history",
    "quick_panel", "sensor_task", "fall_detect", "debug_log", "ui_styles", "lv_port_indev", "lv_port_disp",
)

STATIC = r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]|import\s+['\"]([^'\"]+)['\"]|require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
DYNAMIC = r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
INCLUDE = r"#\s*include\s*[<\"]([^>\"]+)[>\"]"


def package(spec: Column) -> Column:
    """The package of an import that isn't relative: a scope and a name, else the first part."""
    parts = F.split(spec, "/")
    return F.when(spec.startswith("@"), F.when(F.size(parts) >= 2, F.concat_ws("/", parts[0], F.get(parts, F.lit(1))))).otherwise(parts[0])


def package_of_path(path: Column) -> Column:
    """The package that a file lies in: below ``node_modules`` or ``.pio/libdeps/<environment>``; null elsewhere."""
    node = F.regexp_extract(path, r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)", 1)
    pio = F.regexp_extract(path, r"(?:^|/)\.pio/libdeps/[^/]+/([^/]+)", 1)
    return F.coalesce(F.nullif(node, F.lit("")), F.nullif(pio, F.lit("")))


def _all(code: Column, pattern: str, groups: int) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(code, F.lit(pattern), F.lit(i + 1)) for i in range(groups)]))
    return F.filter(found, lambda x: x != "")


def static_packages(code: Column) -> Column:
    """Packages of import and require; relative paths, file names and words that only look so are none."""
    keep = F.filter(_all(code, STATIC, 3), lambda s: ~s.startswith(".") & ~s.startswith("/") & (~s.contains(".") | s.startswith("@")) & ~F.lower(s).isin(*NO_PACKAGE))
    return F.filter(F.transform(keep, package), lambda x: x.isNotNull())


def dynamic_packages(code: Column) -> Column:
    keep = F.filter(_all(code, DYNAMIC, 1), lambda s: ~s.startswith(".") & ~s.startswith("/"))
    return F.filter(F.transform(keep, package), lambda x: x.isNotNull())


def included_packages(code: Column) -> Column:
    """Packages of include lines: the directory, or what a single header stands for; headers of systems and of one or two letters are none."""
    known = F.create_map(*[F.lit(x) for kv in HEADER_PACKAGES.items() for x in kv])

    def one(i: Column) -> Column:
        name = F.regexp_replace(F.substring_index(i, "/", 1), r"\.h(h|pp|xx)?$", "")
        return F.when(i.contains("/"), F.substring_index(i, "/", 1)).otherwise(F.coalesce(F.try_element_at(known, name), F.when(F.length(name) > 2, name)))

    ours = F.filter(_all(code, INCLUDE, 1), lambda i: ~i.rlike("^(" + "|".join(SYSTEM_HEADERS) + ")"))
    return F.filter(F.transform(ours, one), lambda x: x.isNotNull())


def packages(code: Column) -> Column:
    """All packages that code names, each once."""
    return F.array_distinct(F.concat(static_packages(code), dynamic_packages(code), included_packages(code)))


def listed_by_nature(pkg: Column) -> Column:
    """Whether a package needs no declaration: a framework's header, or one of the project's own."""
    return pkg.rlike("^(" + "|".join(FRAMEWORK_STARTS) + ")") | pkg.isin(*FRAMEWORK_HEADERS, *LOCAL_HEADERS)
